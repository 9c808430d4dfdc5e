"""Typed access to the driver's parquet tables.

Tables are read lazily with ``spark.read.parquet``; Catalyst prunes
columns and pushes filters into each scan, so callers only ever select
what they use. Timestamps stay as the wall-clock (NTZ) values the files
hold; ``chartwise.functions.time`` converts them for arithmetic.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Named DataFrames over one folder of ``<name>.parquet`` files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(self.path(name))
        return self._frames[name]
