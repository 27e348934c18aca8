"""Shared helpers: tables written to the shared folder, worker-side caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.  Only a local
    session (tests), where driver and executors are one process, may leave it
    unset and gets a temporary folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="cohortix-llm-"))
    return "file://" + _LOCAL_ROOT[0]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    with files that outlive every executor."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process.  (Functions are
    shipped by value, so their own globals would not outlive a task.)"""
    mod = sys.modules.setdefault("_cohortix_llm_worker", types.ModuleType("_cohortix_llm_worker"))
    return mod.__dict__.setdefault("cache", {})


def release_memory(keep=None) -> None:
    """Give back what a reused worker still holds: other operators' caches (all but
    the one named ``keep``) and the free pages of Arrow and of the C heap, which an
    earlier stage's arrays leave."""
    import ctypes
    import gc

    import pyarrow as pa
    for key in worker_cache().keys() - {keep}:
        del worker_cache()[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # another C library
        pass


def with_columns_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """Only ``cols``; columns a table lacks come as nulls, and further columns
    (whatever their names) never reach the operator."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).alias(c) for c in cols])


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
