"""Folders that the driver and every executor see.

Tables that one job writes and a later job reads lie below
``spark.checkpoint.dir``.  Only a local session, where driver and executors are
one process, may leave it unset; it gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="cohortix-"))
    return "file://" + _LOCAL[0]


def new_folder(spark: SparkSession, tag: str) -> str:
    """An unused path; nothing is created there."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a new folder and read from there: computed once, however
    many readers and later jobs it has."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
