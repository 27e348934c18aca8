"""Module adoption: distribution of module counts (M23), customer-quarter
module panel (M25) and its year-over-year change (M26).

Inputs (all at customer-day grain):
  lines: customer_id, dt, module, qty      -- product rows of live accounts
  live:  customer_id, dt                   -- live account days
  tds:   customer_id, dt, tds_tx           -- payment transactions
  ec:    customer_id, dt                   -- payroll presence
A quarter's snapshot is taken from ``snapshot``: 'quarter_end' keeps the rows of
the quarter's last day, from a dense daily source or from states read there
(``quarter_end_states``); 'quarter' keeps every row of the quarter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import is_last_month_of_quarter, is_quarter_end, quarter_start
from ..operators.intervals import at_quarter_ends, validity
from ..operators.joins import period_lookback

BUCKETS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
PLUS = {"three_plus": 3, "four_plus": 4, "five_plus": 5, "six_plus": 6}


def _snap(df: DataFrame, snapshot: str) -> DataFrame:
    return df.filter(is_quarter_end("dt")) if snapshot == "quarter_end" else df


def quarter_end_states(changes: DataFrame, keys: list[str], states: list[str], ends: DataFrame, as_of: str,
                       since: str, term_days: int | None = None) -> DataFrame:
    """The states that stand on quarter ends, from a source of changes
    (customer_id, the other keys, dt, states).  A state holds until the next change
    of its keys, for ``term_days`` at most, and not from the customer's end date
    (``ends``: customer_id, end_date or null) on."""
    c = changes.join(ends, "customer_id", "left")
    until = F.least(F.date_add("dt", term_days), F.col("end_date")) if term_days else F.col("end_date")
    return at_quarter_ends(validity(c, keys, "dt", states, until, join_equal=False), as_of, since)


def module_quarters(lines: DataFrame, live: DataFrame, tds: DataFrame, ec: DataFrame,
                    modules: dict[str, str], counted: list[str], since: str,
                    snapshot: str = "quarter_end") -> DataFrame:
    """customer_id, quarter, <module>_count..., tds_count, ec_count, unique_mod.

    Grain: every live (customer, quarter).  Module, tds and ec facts hang on
    the module row (as in the source query): a live quarter without any
    module row gets null counts and a null ``unique_mod``.
    """
    s = F.lit(since).cast("date")
    q = quarter_start("dt").alias("quarter")
    lv = _snap(live.filter(F.col("dt") >= s), snapshot).select("customer_id", q).distinct()
    lm = _snap(lines.filter(F.col("dt") >= s), snapshot)
    cm = lm.groupBy("customer_id", q).agg(*[
        F.sum(F.when(F.col("module") == v, F.col("qty")).otherwise(0.0)).alias(f"{k}_count")
        for k, v in modules.items()])
    cm = cm.withColumn("module_count", sum(F.when(F.col(f"{k}_count") > 0, 1).otherwise(0) for k in counted))
    td = (tds.filter(is_last_month_of_quarter("dt")).groupBy("customer_id", q)
             .agg(F.sum("tds_tx").alias("tds_tx"))
             .select("customer_id", "quarter", F.when(F.col("tds_tx") > 0, 1).otherwise(0).alias("tds_count")))
    e = ec.filter(F.col("dt") >= s).select("customer_id", q).distinct().withColumn("ec", F.lit(1))
    # tds/ec join on the module side's keys (a null module row matches nothing)
    cm = (cm.join(td, ["customer_id", "quarter"], "left").join(e, ["customer_id", "quarter"], "left"))
    j = lv.join(cm, ["customer_id", "quarter"], "left")
    has = F.col("module_count").isNotNull()
    return j.select(
        "customer_id", "quarter", *[f"{k}_count" for k in modules],
        F.when(has, F.coalesce("tds_count", F.lit(0))).otherwise(0).alias("tds_count"),
        F.when(has, F.coalesce("ec", F.lit(0))).otherwise(0).alias("ec_count"),
        (F.col("module_count") + F.coalesce("tds_count", F.lit(0)) + F.coalesce("ec", F.lit(0)))
        .alias("unique_mod"))


def module_distribution(mq: DataFrame) -> DataFrame:
    """Per quarter, customers with exactly 0..5 and at least 3..6 modules
    and their percentages of all live customers (bround 2)."""
    u = F.col("unique_mod")
    # (customer, quarter) is unique in mq, so count_if == count(distinct)
    aggs = [F.count("customer_id").alias("ct")]
    aggs += [F.count_if(u == v).alias(k) for k, v in BUCKETS.items()]
    aggs += [F.count_if(u >= v).alias(k) for k, v in PLUS.items()]
    g = mq.groupBy("quarter").agg(*aggs)
    pct = [F.bround(F.col(k) / F.col("ct") * 100, 2).alias(f"{k}_pct") for k in list(BUCKETS) + list(PLUS)]
    return g.select("quarter", "ct", *BUCKETS, *PLUS, *pct)


def module_yoy(panel: DataFrame, cols: list[str], months: int = 15) -> DataFrame:
    """Each (customer, quarter) with the same customer's values from
    ``months`` earlier (inner match) and the module-count change."""
    j = period_lookback(panel.select("customer_id", "quarter", *cols), ["customer_id"], "quarter",
                        cols, months, "_ly")
    return j.withColumn("mod_count_change", F.col("mod_count") - F.col("mod_count_ly"))
