"""Listing, integrity and tolerant reading of record folders and result files."""

from __future__ import annotations

import datetime
from abc import ABC, abstractmethod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagmeter.sources import files as files_

#: Columns of a bag result file.
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("bag_id", T.LongType()), T.StructField("bag_size", T.IntegerType()), T.StructField("method", T.StringType()),
        T.StructField("classifier", T.StringType()), T.StructField("mae", T.DoubleType()), T.StructField("pred_pos", T.DoubleType()),
        T.StructField("true_pos", T.DoubleType()),
    ]
)


class Source(ABC):
    """A data set that can be loaded; ``ingest`` does nothing if its manifest is there already."""

    name: str

    @abstractmethod
    def load(self, spark: SparkSession) -> DataFrame:
        """The records."""

    def ingest(self, spark: SparkSession, target: str, overwrite: bool = False) -> dict:
        """Write the records as parquet with a manifest of their number and time; returns the manifest."""
        at = f"{target}/manifest.json"
        known = files_.read_json(spark, at)
        if known is not None and not overwrite:
            return known
        self.load(spark).write.mode("overwrite").parquet(f"{target}/records")
        n = spark.read.parquet(f"{target}/records").count()
        manifest = {"name": self.name, "n_records": n, "written_at": datetime.datetime.now(datetime.UTC).isoformat()}
        files_.write_json(spark, at, manifest)
        return manifest


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``stem``, ``ext``, ``length`` of the files in a folder; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return listed.select(F.regexp_extract(name, r"^(.*)\.[^.]+$", 1).alias("stem"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("ext"), "length")


def incomplete(listing: DataFrame, main: str = "dat", companions: tuple[str, ...] = ("hea", "atr")) -> DataFrame:
    """``stem``, ``missing``: records whose main file lacks a companion."""
    wanted = listing.where(F.col("ext") == main).select("stem", F.explode(F.array(*map(F.lit, companions))).alias("missing"))
    present = listing.select("stem", F.col("ext").alias("missing"))
    return wanted.join(present, ["stem", "missing"], "left_anti")


def is_complete(listing: DataFrame, expected: int, main: str = "dat", companions: tuple[str, ...] = ("hea", "atr")) -> bool:
    """Whether there are ``expected`` files of each kind at least and no record lacks a companion."""
    counts = {r["ext"]: r["n"] for r in listing.where(F.col("ext").isin(main, *companions)).groupBy("ext").agg(F.count("*").alias("n")).collect()}
    return min(counts.get(e, 0) for e in (main, *companions)) >= expected and incomplete(listing, main, companions).isEmpty()


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """A bag result file with its fixed schema."""
    return spark.read.csv(path, header=True, schema=RESULT_SCHEMA)


def try_read(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None where there is none, so that reports can leave a section out."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
