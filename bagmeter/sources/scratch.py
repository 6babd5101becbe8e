"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage here: a written table survives the loss of
an executor, and it is smaller than a checkpoint of rows because it is columnar.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from bagmeter.sources.files import place

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder; a session
    on a cluster gets an error, since a folder of one machine is of no use there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(_LOCAL[key])
        atexit.register(shutil.rmtree, _LOCAL[key], True)
    return f"file://{_LOCAL[key]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, target = place(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            files, target = place(df.sparkSession, path)
            files.delete(target, True)
