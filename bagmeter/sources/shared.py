"""Tables that several queries derive from the same input, written once per application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bagmeter.sources import files
from bagmeter.sources.scratch import stage

_KNOWN: dict[tuple, tuple] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another state is another table."""
    place, target = files.place(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in place.listStatus(target)))


def shared(spark: SparkSession, sf_dir: str, inputs: tuple[str, ...], name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` derives from the ``inputs`` in ``sf_dir``; made and written to the shared folder at the first call.

    Later calls of the application read the written table as long as the inputs' files are the same.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, *(_state(spark, f"{sf_dir}/{t}.parquet") for t in inputs))
    if key not in _KNOWN or not files.exists(spark, _KNOWN[key][0]):
        made = stage(make(), name)
        _KNOWN[key] = (made._scratch_path, made.schema)
    path, schema = _KNOWN[key]
    return spark.read.schema(schema).parquet(path)
