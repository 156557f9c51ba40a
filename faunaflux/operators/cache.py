"""Artefacts by content key: Parquet under <root>/<two digits>/<key>, written once and read by every executor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .report import hash_json


class ArtefactCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.hits, self.misses = spark, root, 0, 0

    @staticmethod
    def key(**parts) -> str:
        return hash_json(parts)

    def path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}"

    def get(self, key: str) -> DataFrame | None:
        """The artefact, or None: one that is not there, or was not committed, is a miss."""
        try:
            found = self.spark.read.parquet(self.path(key))
        except AnalysisException:
            self.misses += 1
            return None
        self.hits += 1
        return found

    def put(self, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(key))
        return self.spark.read.parquet(self.path(key))

    def get_or_compute(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(key)
        return found if found is not None else self.put(key, compute())
