"""Small files and folders in any file system that Spark knows (local, HDFS, object stores)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """The file system and path object of ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = place(spark, path)
    return files.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    files, target = place(spark, path)
    files.mkdirs(target)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all it holds; nothing if there is none."""
    files, target = place(spark, path)
    files.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    files, target = place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def read_json(spark: SparkSession, path: str):
    """The content of a JSON file, None if there is none."""
    files, target = place(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.scala.io.Source.fromInputStream(stream, "UTF-8").mkString())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, content) -> None:
    """Write a JSON file beside its place, then put it there, so readers see the old or the new one."""
    files, target = place(spark, path)
    _, fresh = place(spark, f"{path}.tmp")
    files.mkdirs(target.getParent())
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(json.dumps(content, indent=1, sort_keys=True).encode()))
    finally:
        stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    qualified = files.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        files.makeQualified(fresh), qualified, how
    )
