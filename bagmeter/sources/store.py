"""Fitted models and tables that are computed once and read by later runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from bagmeter.sources import files


class ArtifactStore:
    """Tables, MLlib models and small records under ``root``, a folder that the driver and the executors share.

    A key is made of the parts that an artifact depends on. An artifact counts once its entry in the index
    is written, which is last, so a run that stops in between makes it again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def key(*parts: object) -> str:
        return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]

    def _at(self, *parts: object) -> str:
        return f"{self.root}/{self.key(*parts)}"

    def has(self, *parts: object) -> bool:
        return files.exists(self.spark, f"{self._at(*parts)}/entry.json")

    def entries(self) -> list[dict]:
        """What is in the store: the parts of each key and its kind."""
        found = (files.read_json(self.spark, f"{self.root}/{n}/entry.json") for n in files.names(self.spark, self.root))
        return [e for e in found if e is not None]

    def _finish(self, kind: str, parts: tuple, more: object = None) -> None:
        files.write_json(self.spark, f"{self._at(*parts)}/entry.json", {"kind": kind, "parts": json.loads(json.dumps(parts, default=str)), "content": more})

    def table(self, make: Callable[[], DataFrame], *parts: object) -> DataFrame:
        """The table of a key; made and written if it isn't there."""
        path = f"{self._at(*parts)}/table"
        if not self.has(*parts):
            make().write.mode("overwrite").parquet(path)
            self._finish("table", parts)
        return self.spark.read.parquet(path)

    def model(self, fit: Callable[[], PipelineModel], *parts: object) -> PipelineModel:
        """The fitted pipeline of a key; fitted and saved if it isn't there."""
        path = f"{self._at(*parts)}/model"
        if not self.has(*parts):
            fit().write().overwrite().save(path)
            self._finish("model", parts)
        return PipelineModel.load(path)

    def record(self, make: Callable[[], object], *parts: object):
        """A small value (thresholds, temperatures, class shares) of a key; made and written if it isn't there."""
        if not self.has(*parts):
            self._finish("record", parts, make())
        return files.read_json(self.spark, f"{self._at(*parts)}/entry.json")["content"]

    def drop(self, *parts: object) -> None:
        files.delete(self.spark, self._at(*parts))
