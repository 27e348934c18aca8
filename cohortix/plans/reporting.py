"""Reporting metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import month_start
from ..functions.nulls import zsum
from ..operators.aggregates import conditional_distinct


def key_metrics(panel: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Monthly and quarterly totals of ``measures`` ({out: in}) with
    period_type ('FULL MONTH' / 'QUARTER'), period_name, start and end date."""
    m = panel.groupBy(F.col("month").alias("start_date")).agg(
        *[F.sum(c).alias(o) for o, c in measures.items()])
    m = m.select(F.lit("FULL MONTH").alias("period_type"),
                 F.date_format("start_date", "yyyy-MM").alias("period_name"), "start_date",
                 F.last_day("start_date").alias("end_date"), *measures)
    q = panel.groupBy(F.trunc("month", "quarter").alias("start_date")).agg(
        *[F.sum(c).alias(o) for o, c in measures.items()])
    q = q.select(F.lit("QUARTER").alias("period_type"),
                 F.concat(F.lit("Q"), F.quarter("start_date"), F.lit("-"), F.year("start_date"))
                 .alias("period_name"), "start_date",
                 F.date_sub(F.add_months("start_date", 3), 1).alias("end_date"), *measures)
    return m.unionByName(q)


def arr_report(metrics: DataFrame, period_type: str = "FULL MONTH") -> DataFrame:
    """One period type, ARR columns as doubles with null -> 0, newest
    first (ordering only matters for the final display)."""
    cols = [c for c in metrics.columns if c not in ("period_type", "period_name", "start_date", "end_date")]
    return (metrics.filter(F.col("period_type") == period_type)
                   .select("period_name", "start_date", "end_date",
                           *[F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 2).alias(c) for c in cols])
                   .orderBy(F.col("start_date").desc()))


def annualized_volume(payments: DataFrame) -> DataFrame:
    """Monthly sums of a daily payment feed and their annualised
    values (sum / days in month * 365).  payments: dt, volume, tx."""
    g = payments.groupBy(month_start("dt").alias("month")).agg(
        F.sum("volume").alias("monthly_gpv"), F.sum("tx").alias("monthly_gpv_tx"))
    days = F.dayofmonth(F.last_day("month"))
    return g.select("month", days.alias("days_in_month"),
                    F.round(F.col("monthly_gpv") / days * 365, 2).alias("annualized_gpv"),
                    F.round(F.col("monthly_gpv_tx") / days * 365, 4).alias("annualized_gpv_tx"),
                    F.round("monthly_gpv", 2).alias("monthly_gpv"), "monthly_gpv_tx")


def churn_counts(snapshot: DataFrame) -> DataFrame:
    """Per month, distinct accounts whose churn month is that month,
    split by whether they ever went live (first order date present).
    snapshot: customer_id, month, churn_date, first_order_date."""
    same = month_start("churn_date") == F.col("month")
    return conditional_distinct(snapshot, ["month"], "customer_id", {
        "churns": same & F.col("first_order_date").isNotNull(),
        "cancelled_contracts": same & F.col("first_order_date").isNull()})


def new_parents(deals: DataFrame) -> DataFrame:
    """Parents by the month of their first won deal.
    deals: parent_id, close_date, is_won."""
    first = (deals.filter(F.col("is_won")).groupBy("parent_id")
                  .agg(F.min(month_start("close_date")).alias("month")))
    return first.groupBy("month").agg(F.count("parent_id").alias("new_booked_accounts"))


def month_end_parents(snapshot: DataFrame) -> DataFrame:
    """Per month, distinct parents with a booked (Live or Backlog) and
    with a live month-end location.  snapshot: parent_id, month, status."""
    return conditional_distinct(snapshot, ["month"], "parent_id", {
        "booked_accounts": F.col("status").isin("Live", "Backlog"),
        "live_accounts": F.col("status") == "Live"})


def customer_report(churns: DataFrame, new: DataFrame, month_end: DataFrame) -> DataFrame:
    """The three count tables merged on month (months of the churn
    table; missing counts -> 0)."""
    j = churns.join(new, "month", "left").join(month_end, "month", "left")
    return j.select("month", "churns", "cancelled_contracts",
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in
                      ("new_booked_accounts", "booked_accounts", "live_accounts")])
