"""Spark session settings used by every pipeline.

Pipelines never call ``current_date()``: every date bound is an ``as_of``
parameter, so results are reproducible.  ANSI mode stays on; division goes
through the helpers in :mod:`cohortix.functions.nulls`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Cluster sizing (applied when no local master is given, i.e. the launcher
# decides): start shuffles with many partitions and let AQE merge them to
# ~256 MB; split skewed partitions above 5x the median / 512 MB.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cohortix", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    On a cluster ``master`` stays ``None`` and the launcher decides; the
    shuffle partition count is then left to AQE coalescing unless given.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if not master:
        for k, v in CLUSTER_CONF.items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:   # local mode: the driver JVM is the executor; only effective at JVM start
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
