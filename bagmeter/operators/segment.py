"""From signals and annotations to fixed-size windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagmeter.functions import arrays

NORMALIZERS = {"zscore": arrays.zscore, "minmax": arrays.minmax, "none": lambda a: a}
LENGTHS = {"pad": arrays.pad, "interpolate": arrays.interpolate}


def peaks(signal: Column, least: float) -> Column:
    """Positions (from 0) of inner samples above ``least`` that exceed the one before and aren't below the next."""
    inner = F.sequence(F.lit(1), F.size(signal) - 2)
    at = lambda i: F.element_at(signal, i + 1)
    found = F.filter(inner, lambda i: (at(i) > least) & (at(i) > at(i - 1)) & (at(i) >= at(i + 1)))
    return F.when(F.size(signal) >= 3, found).otherwise(F.array().cast("array<int>"))


def windows(df: DataFrame, keep: list[str], signal: str, samples: str, width: int, length: str = "pad", normalize: str = "none") -> DataFrame:
    """``keep``, ``ann_idx``, ``sample``, ``segment``: one window per annotation.

    A window starts half its width before the annotation, at 0 at the earliest, so early ones are
    off-centre; at the signal's end it is short and is padded with zeros or resampled, and then
    normalized. Windows are cut out of the signal before rows are multiplied, so a signal isn't copied per annotation.
    """
    if length not in LENGTHS or normalize not in NORMALIZERS:
        raise ValueError(f"unknown length mode or normalization: {length}, {normalize}")

    def cut(sample: Column) -> Column:
        return F.slice(F.col(signal), F.greatest(sample - width // 2, F.lit(0)) + 1, F.lit(width))

    cuts = F.transform(samples, lambda s, i: F.struct(i.alias("ann_idx"), s.alias("sample"), cut(s).alias("raw")))
    rows = df.where(F.col(signal).isNotNull()).select(*keep, F.explode(cuts).alias("_w")).where(F.size("_w.raw") > 0)
    shaped = LENGTHS[length](F.col("_w.raw"), width)
    return rows.select(*keep, "_w.ann_idx", "_w.sample", shaped.alias("segment")).withColumn("segment", NORMALIZERS[normalize](F.col("segment")))
