"""Module attach rates on won new-business opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import week_start


def opportunity_flags(opps: DataFrame, items: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """One row per opportunity with a boolean per module family.

    opps: opp_id, opp_type, close_date, is_won; items: opp_id, product.
    Items are filtered to the families' products before the left join, so
    opportunities without such items stay (with false flags)."""
    wanted = [p for ps in families.values() for p in ps]
    it = items.filter(F.col("product").isin(*wanted))
    flags = it.groupBy("opp_id").agg(*[F.bool_or(F.col("product").isin(*ps)).alias(f) for f, ps in families.items()])
    o = opps.filter(F.col("is_won"))
    return (o.join(flags, "opp_id", "left")
             .fillna(False, subset=list(families))
             .withColumn("close_week", week_start("close_date"))
             .withColumn("close_month", F.trunc("close_date", "month")))


def attach_by_age(flags: DataFrame, acquired: dict[str, str], as_of: str,
                  opp_type: str = "New Business") -> DataFrame:
    """Per family and days from the family's acquisition date to the
    close week (> 0): distinct opportunities, attached ones and the rate
    (bround 2).  Only opportunities closed before the ``as_of`` week."""
    base = flags.filter((F.col("opp_type") == opp_type) &
                        (F.col("close_date") < week_start(F.lit(as_of).cast("date"))))
    long = base.select("opp_id", "close_week", F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(d).cast("date").alias("acq"), F.col(f).alias("hit"))
        for f, d in acquired.items()])).alias("u")).select("opp_id", "close_week", "u.*")
    long = long.withColumn("days_from_acquisition", F.datediff("close_week", "acq")) \
               .filter(F.col("days_from_acquisition") > 0)
    g = long.groupBy("family", "days_from_acquisition").agg(
        F.count_distinct("opp_id").alias("opps"), F.count_if("hit").alias("attached"))
    return g.withColumn("attach_rate", F.bround(100 * F.col("attached") / F.col("opps"), 2))


def attach_by_month(flags: DataFrame, families: list[str], as_of: str,
                    opp_type: str = "New Business") -> DataFrame:
    """Per close month: distinct opportunities, attached counts and
    rates per family."""
    base = flags.filter((F.col("opp_type") == opp_type) &
                        (F.col("close_date") < week_start(F.lit(as_of).cast("date"))))
    g = base.groupBy("close_month").agg(F.count_distinct("opp_id").alias("opps"),
                                        *[F.count_if(f).alias(f) for f in families])
    for f in families:
        g = g.withColumn(f"{f}_attach", F.bround(100 * F.col(f) / F.col("opps"), 2))
    return g
