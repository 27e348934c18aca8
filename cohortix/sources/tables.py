"""Parquet table access by name.

``Tables(spark, root)`` resolves ``root/<name>.parquet``; a ``db.name`` (or a
registered catalog table) is resolved through the catalog instead.  Reads are
lazy, so Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


CACHE_READS = True


class Tables:
    def __init__(self, spark: SparkSession, root: str | None = None, database: str | None = None):
        self.spark = spark
        self.root = root
        self.database = database
        self._frames: dict[str, DataFrame] = {}
        self.memo: dict = {}   # derived (lazy) frames of fixture builders

    def __call__(self, name: str) -> DataFrame:
        """The table as a lazy DataFrame; one object per name, so the file
        listing/footer read happens once and reused sub-plans are identical."""
        if name not in self._frames or not CACHE_READS:
            if self.root and "." not in name:
                df = self.spark.read.parquet(os.path.join(self.root, f"{name}.parquet"))
            else:
                full = f"{self.database}.{name}" if self.database and "." not in name else name
                df = self.spark.table(full)
            self._frames[name] = df
        return self._frames[name]

    def register(self, *names: str) -> None:
        """Expose the given tables as temp views (for SQL-first pipelines)."""
        for n in names:
            self(n).createOrReplaceTempView(n)
