"""Calendar, hour and period spines generated with ``sequence``/``explode``.

Spines are bounded by their date range (months, days, hours between two
dates), never by the data volume, so they are safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _d(x):
    return F.lit(x).cast("date") if isinstance(x, str) else x


def month_spine(spark: SparkSession, start, end, name: str = "month") -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.trunc(_d(start), "month"), F.trunc(_d(end), "month"),
                             F.expr("INTERVAL 1 MONTH"))).alias(name))


def day_spine(spark: SparkSession, start, end, name: str = "dt") -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(_d(start), _d(end), F.expr("INTERVAL 1 DAY"))).alias(name))


def hour_spine(spark: SparkSession, start, end, name: str = "hour") -> DataFrame:
    """Every hour from ``start`` 00:00 to ``end`` 23:00 (TIMESTAMP_NTZ)."""
    s = F.to_timestamp_ntz(F.date_format(_d(start), "yyyy-MM-dd"))
    e = F.to_timestamp_ntz(F.date_format(_d(end), "yyyy-MM-dd")) + F.expr("INTERVAL 23 HOURS")
    return spark.range(1).select(F.explode(F.sequence(s, e, F.expr("INTERVAL 1 HOUR"))).alias(name))


def period_table(spark: SparkSession, months: DataFrame, lengths=(30, 60, 90, 180, 270, 365),
                 month_col: str = "month") -> DataFrame:
    """Backward and forward periods per month: one row per
    (month, length, direction) with ``period_start``/``period_end``.

    backward: [month - length days, month];  forward: [month, month + length days].
    """
    shapes = F.array(*[F.struct(F.lit(n).alias("daysinperiod"), F.lit(d).alias("period_type"))
                       for d in ("backward", "forward") for n in lengths])
    m = F.col(month_col)
    return (months.select(m.alias("month"), F.explode(shapes).alias("p")).select("month", "p.*")
            .withColumn("period_start", F.when(F.col("period_type") == "backward",
                                               F.date_sub("month", F.col("daysinperiod")))
                        .otherwise(F.col("month")))
            .withColumn("period_end", F.when(F.col("period_type") == "backward", F.col("month"))
                        .otherwise(F.date_add("month", F.col("daysinperiod")))))
