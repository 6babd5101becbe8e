"""A finished experiment as a folder of parquet tables with an index, and the reader of it."""

from __future__ import annotations

import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.sources import files
from bagmeter.sources.checkpoint import fingerprint

TABLES = ("instances", "scores", "bag_truth", "bag_members", "results")
#: Greatest difference of recorded and recomputed prevalences.
TOLERANCE = 1e-8


def verify_bags(truth: DataFrame, members: DataFrame, instances: DataFrame) -> None:
    """Raise if a bag's members don't have the recorded prevalences.

    ``truth``: ``bag_size``, ``bag_index``, ``label``, ``prevalence``; ``members``: bag and ``instance_id``;
    ``instances``: ``instance_id``, ``y``.
    """
    key = ["bag_size", "bag_index"]
    drawn = members.join(instances.select("instance_id", F.col("y").alias("label")), "instance_id").groupBy(*key, "label").agg(F.count("*").alias("m"))
    gap = F.abs(F.coalesce("prevalence", F.lit(0.0)) - F.coalesce("m", F.lit(0)) / F.col("bag_size"))
    worst = truth.join(drawn, [*key, "label"], "full").agg(F.max(gap).alias("g")).first()["g"] or 0.0
    if worst > TOLERANCE:
        raise ValueError(f"bags differ from their recorded prevalences by {worst}")


def environment() -> dict[str, str]:
    """Versions that a bundle is written with."""
    return {"python": platform.python_version(), "spark": pyspark.__version__}


def export_bundle(target: str, experiment: str, tables: dict[str, DataFrame], config: dict) -> None:
    """Write the tables of one experiment and add it to the index; scores are stored as floats."""
    root, spark = target.rstrip("/"), next(iter(tables.values())).sparkSession
    if "bag_truth" in tables and "bag_members" in tables and "instances" in tables:
        verify_bags(tables["bag_truth"], tables["bag_members"], tables["instances"])
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table: {name}")
        if name == "scores" and "p" in df.columns and dict(df.dtypes)["p"] == "double":
            df = df.withColumn("p", F.col("p").cast("float"))
        df.write.mode("overwrite").parquet(f"{root}/{experiment}/{name}")
    index = files.read_json(spark, f"{root}/bundle.json") or {"format": 1, "experiments": {}}
    hashes = {n: fingerprint(df, df.columns) for n, df in tables.items() if n in ("bag_truth", "bag_members")}
    index["experiments"][experiment] = {"tables": sorted(tables), "config": config, "hashes": hashes}
    index["environment"] = environment()
    files.write_json(spark, f"{root}/bundle.json", index)


class ExportedBundle:
    """Reads a bundle; every method gives a DataFrame."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root = spark, path.rstrip("/")
        self.index = files.read_json(spark, f"{self.root}/bundle.json")
        if self.index is None:
            raise FileNotFoundError(f"no bundle at {path}")

    @property
    def experiments(self) -> list[str]:
        return sorted(self.index["experiments"])

    def owner(self, table: str) -> str:
        """The first experiment, by name, that has a table."""
        for name in self.experiments:
            if table in self.index["experiments"][name]["tables"]:
                return name
        raise KeyError(table)

    def table(self, table: str, experiment: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{experiment or self.owner(table)}/{table}")

    def splits(self, split: str) -> DataFrame:
        return self.table("instances").where(F.col("split") == split)

    def results(self) -> DataFrame:
        """Results of all experiments that have some, with their name."""
        out = None
        for name in self.experiments:
            if "results" in self.index["experiments"][name]["tables"]:
                part = self.table("results", name).withColumn("experiment", F.lit(name))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise KeyError("results")
        return out

    def bag_instances(self, bag_size: int, bag_index: int) -> DataFrame:
        """Members of one bag with their label and, where stored, their scores."""
        bag = self.table("bag_members").where((F.col("bag_size") == bag_size) & (F.col("bag_index") == bag_index))
        out = bag.join(self.table("instances").select("instance_id", "y"), "instance_id")
        try:
            return out.join(self.table("scores"), "instance_id", "left")
        except KeyError:
            return out

    def quantifiers(self) -> list[str]:
        """Names of the estimators that have results, sorted."""
        return sorted(r[0] for r in self.results().select("quantifier").distinct().collect())

    def bags(self, experiment: str | None = None) -> DataFrame:
        """One row for each bag with the shares of its labels as a map."""
        key = [c for c in ("protocol", "bag_size", "bag_index") if c in self.table("bag_truth", experiment).columns]
        shares = F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "prevalence")))).alias("prevalence")
        return self.table("bag_truth", experiment).groupBy(*key).agg(shares)

    def instance_outputs(self, split: str | None = None) -> DataFrame:
        """Instances with label, split and all that is stored of their scores; without features."""
        rows = self.table("instances").select("instance_id", "y", *(c for c in ("split", "record_id") if c in self.table("instances").columns))
        rows = rows if split is None else rows.where(F.col("split") == split)
        scores = self.table("scores")
        return rows.join(scores.select("instance_id", *(c for c in scores.columns if c not in rows.columns)), "instance_id")

    def changed_environment(self) -> dict[str, tuple[str, str]]:
        """Versions that differ from those the bundle was written with: name, then there and here."""
        here, there = environment(), self.index.get("environment", {})
        return {k: (there.get(k, ""), v) for k, v in here.items() if there.get(k) != v}

    def damaged(self, experiment: str | None = None) -> list[str]:
        """Tables whose content isn't what was written, by the fingerprints in the index."""
        out = []
        for name in [experiment] if experiment else self.experiments:
            for table, known in self.index["experiments"][name]["hashes"].items():
                found = self.table(table, name)
                if fingerprint(found, found.columns) != known:
                    out.append(f"{name}/{table}")
        return out
