"""Random numbers that depend on keys only, so neither on partitions nor on the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column | str) -> Column:
    """A double in [0, 1) from the md5 of ``seed|part|part...``; strings are literal, columns are cast to text."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int, *parts: str) -> str:
    """The same number in DuckDB's SQL; ``parts`` are SQL expressions."""
    key = " || '|' || ".join([f"'{seed}'", *(f"cast({p} as varchar)" for p in parts)])
    return f"(cast('0x' || substr(md5({key}), 1, 8) as bigint) / 4294967296.0::double)"
