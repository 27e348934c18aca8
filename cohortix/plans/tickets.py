"""Support-ticket feature table (M45/M48) for the module-ticket regressions
(M46), with descriptive statistics and correlations (M47)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import months_between_cal
from ..functions.nulls import row_sum


def population(customers: DataFrame, at: str, young_days: int = 90) -> DataFrame:
    """Accounts live at ``at``: first order on/before it, not churned by it.
    age in calendar months, age bucket by days since first order."""
    a = F.lit(at).cast("date")
    p = customers.filter((F.col("first_order_date") <= a) &
                         (F.col("churn_date").isNull() | (F.col("churn_date") > a)))
    start_age = F.datediff(a, "first_order_date")
    return p.select("customer_id", months_between_cal(a, "first_order_date").alias("age"),
                    F.when(start_age <= young_days, "Less than 3 Months").otherwise("3+ Months").alias("age_bucket"))


def module_state(lines: DataFrame, at: str, end: str, modules: list[str], lookback_days: int = 180) -> DataFrame:
    """customer_id, start_mods (distinct modules in the ``lookback_days``
    before ``at``) and one 0/1 column per module held in [at, end) -- the
    long-to-wide step as one conditional aggregation over the fixed module
    list, from a single pass over the line items.
    lines: customer_id, dt, module."""
    a, e = F.lit(at).cast("date"), F.lit(end).cast("date")
    per = (lines.filter((F.col("dt") >= F.date_sub(a, lookback_days)) & (F.col("dt") < e))
                .groupBy("customer_id", "module")
                .agg(F.bool_or(F.col("dt") < a).alias("in_start"), F.bool_or(F.col("dt") >= a).alias("in_end")))
    return per.groupBy("customer_id").agg(
        F.count_if("in_start").alias("start_mods"),
        *[F.max(F.when((F.col("module") == m) & F.col("in_end"), 1)).alias(m) for m in modules])


def ticket_features(pop: DataFrame, tickets: DataFrame, start_mods: DataFrame, end_mods: DataFrame | None,
                    modules: list[str], devices: DataFrame | None = None,
                    third_party: list[str] | None = None, third_party_min: int = 0) -> DataFrame:
    """Wide feature table: one row per account of ``pop``.

    tickets: customer_id, ticket_count; start_mods: customer_id,
    start_mods (and, when ``end_mods`` is None, the module columns as made
    by :func:`module_state`); end_mods: customer_id, module, is_activated
    (long form, pivoted over the fixed ``modules`` list); devices: customer_id, period
    (1 = start, 2 = end), devices -- the end count is the next period's
    value (lead), as in the source query.  Nulls become 0 after the pivot.
    """
    j = pop.join(tickets, "customer_id", "left").join(start_mods, "customer_id", "left")
    if end_mods is not None:
        wide = (end_mods.groupBy("customer_id").pivot("module", modules)
                        .agg(F.max("is_activated")))
        j = j.join(wide, "customer_id", "left")
    if devices is not None:
        w = Window.partitionBy("customer_id").orderBy("period")
        dv = (devices.withColumn("end_devices", F.lead("devices").over(w))
                     .filter(F.col("period") == 1)
                     .select("customer_id", F.col("devices").alias("start_devices"), "end_devices",
                             (F.col("end_devices") - F.col("devices")).alias("net_device")))
        j = j.join(dv, "customer_id", "left")
    num = [c for c, t in j.dtypes if c not in ("customer_id", "age_bucket") and t != "string"]
    j = j.fillna(0, subset=num)
    end = row_sum(*modules)
    new = {"end_mods": end, "modules_added": end - F.col("start_mods"),
           "end_mod_sq": end * end, "age_sq": F.col("age") * F.col("age")}
    if third_party:
        new["third_party"] = F.when(row_sum(*third_party) > third_party_min, 1).otherwise(0)
    if devices is not None:
        new["end_devices_sq"] = F.col("end_devices") * F.col("end_devices")
    return j.withColumns(new)
