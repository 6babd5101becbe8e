"""Resumable experiments: finished units are partitions of a table and lines of a manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.sources import files


class ExperimentCheckpoint:
    """Results of an experiment by unit, with the configuration they belong to.

    ``root`` is a folder that the driver and the executors share. A unit is marked as done
    after its rows are committed, so a run that stops in between computes it again.
    """

    def __init__(self, spark: SparkSession, root: str, fresh: bool = False) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._manifest = f"{self.root}/manifest.json"
        if fresh:
            files.delete(spark, self._manifest)

    def _state(self) -> dict:
        return files.read_json(self.spark, self._manifest) or {"config": None, "done": {}}

    def _save(self, state: dict) -> None:
        files.write_json(self.spark, self._manifest, state)

    def record_config(self, config: dict) -> None:
        """Keep the configuration, or raise if the results so far belong to another one."""
        state = self._state()
        config = json.loads(json.dumps(config))
        if state["config"] not in (None, config):
            raise ValueError("the checkpoint was written with another configuration")
        self._save(state | {"config": config})

    @staticmethod
    def key(*parts: object) -> str:
        return hashlib.sha1("::".join(map(str, parts)).encode()).hexdigest()[:16]

    def is_done(self, *unit: object) -> bool:
        return self.key(*unit) in self._state()["done"]

    def save(self, rows: DataFrame, *unit: object) -> None:
        """Write the rows of a unit, then mark it; doing it again replaces them."""
        at = f"units/{self.key(*unit)}"
        rows.write.mode("overwrite").parquet(f"{self.root}/{at}")
        state = self._state()
        state["done"][self.key(*unit)] = {"unit": list(map(str, unit)), "path": at}
        self._save(state)

    def results(self) -> DataFrame | None:
        """Rows of all finished units; columns that a unit lacks are null."""
        out = None
        for entry in self._state()["done"].values():
            part = self.spark.read.parquet(f"{self.root}/{entry['path']}")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def done_units(self) -> list[list[str]]:
        return sorted(e["unit"] for e in self._state()["done"].values())

    def pending(self, work: DataFrame, columns: list[str]) -> DataFrame:
        """Units of a work list that aren't done."""
        done = self.done_units()
        if not done:
            return work
        key = F.concat_ws("::", *(F.col(c).cast("string") for c in columns))
        return work.where(~key.isin(["::".join(u) for u in done]))


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """Hash of a table's content that doesn't depend on the order of rows."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{row['n']}|{row['s']}".encode()).hexdigest()
