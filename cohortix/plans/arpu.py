"""Volume per location, ARPU and ARPU headroom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.buckets import cut_right, label_map
from ..functions.nulls import div0, safe_div
from ..operators.joins import latest_rows
from ..operators.quantiles import exact_quantiles

# Tier edges, labels and ranks.
GPV_EDGES = [0, 250000, 500000, 1e6, 3e6, 5e6, float("inf")]
GPV_LABELS = ["< 250k", "250k - 500k", "500k - 1M", "1M - 3M", "3M - 5M", "5M+"]
BPS_EDGES = [float("-inf"), 10, 30, 50, 75, 100, float("inf")]
BPS_LABELS = ["< 10", "10 - 30", "30 - 50", "50 - 75", "75 - 100", "100+"]


def trailing_volume(book: DataFrame, n: int = 12) -> DataFrame:
    """Trailing ``n``-row volume of months after the first order, its
    month count and the annualised volume ``div0(sum, months) * 12``.
    book: customer_id, month, fod, gpv, ... (one row per live month)."""
    w = Window.partitionBy("customer_id").orderBy("month").rowsBetween(-(n - 1), 0)
    after = F.col("fod") < F.col("month")
    # the trailing sum is kept in cents; the annualised value divides that
    # exact amount (no second rounding: sum / 8 * 12 can end in a 5)
    b = book.withColumns({
        "gpv_last_n_months": F.round(F.sum(F.when(after, F.col("gpv")).otherwise(0.0)).over(w), 2),
        "last_months": F.count(F.when(after, F.col("month"))).over(w)})
    return b.withColumn("annualized_gpv", div0("gpv_last_n_months", "last_months") * 12)


def split_usage(m33: DataFrame, fixed: DataFrame) -> DataFrame:
    """Usage part of EC ARR = EC ARR - fixed subscription ARR.
    fixed: customer_id, month, ec_monthly_arr."""
    j = m33.join(fixed, ["customer_id", "month"], "left").fillna(0.0, subset=["ec_monthly_arr"])
    return j.withColumn("ec_usage_arr", F.col("ec_saas_arr") - F.col("ec_monthly_arr"))


def _percent_of(df: DataFrame, by: str, col: str, name: str) -> DataFrame:
    tot = df.groupBy(by).agg(F.sum(col).alias("_t"))
    return (df.join(tot, by).withColumn(name, F.bround(100 * F.col(col) / F.col("_t"), 2)).drop("_t"))


def booking_cohort(m33: DataFrame, group: str, arr_cols: list[str], exact_months: int = 3,
                   start: str | None = None, end: str | None = None) -> DataFrame:
    """Each location's latest month having exactly ``exact_months``
    observed months and positive volume; by close quarter x group:
    locations, average annual volume (thousands, bround 2), the sum and the
    ARPU of each ARR column and the share of the quarter's locations."""
    b = m33.filter((F.col("last_months") == exact_months) & (F.col("gpv") > 0))
    b = latest_rows(b.select("customer_id", "month", "close_quarter", group, "annualized_gpv", *arr_cols), ["customer_id"], "month")
    g = b.groupBy("close_quarter", group).agg(
        F.count("customer_id").alias("locations"),     # a location once
        F.sum("annualized_gpv").alias("annualized_gpv"), *[F.sum(c).alias(c) for c in arr_cols])
    g = g.withColumn("avg_gpv", F.bround(F.col("annualized_gpv") / F.col("locations") / 1e3, 2)) \
         .withColumns({f"{c}_arpu": F.col(c) / F.col("locations") for c in arr_cols})
    if start:
        g = g.filter(F.col("close_quarter") >= F.lit(start).cast("date"))
    if end:
        g = g.filter(F.col("close_quarter") < F.lit(end).cast("date"))
    return _percent_of(g, "close_quarter", "locations", "percent_of_locations")


def live_month_averages(m33: DataFrame, group: str, arr_cols: dict[str, str], min_months: int = 3,
                        min_n: int = 50, start: str | None = None, end: str | None = None) -> DataFrame:
    """By month x group over locations with at least ``min_months``
    observed months: locations, ARR sums and ARPUs, share of the month's
    locations; groups with more than ``min_n`` locations."""
    b = m33.filter(F.col("last_months") >= min_months)
    g = b.groupBy("month", group).agg(F.count_distinct("customer_id").alias("locations"),
                                      *[F.sum(c).alias(o) for o, c in arr_cols.items()])
    for o in arr_cols:
        g = g.withColumn(f"{o}_arpu", F.col(o) / F.col("locations"))
    if start:
        g = g.filter(F.col("month") >= F.lit(start).cast("date"))
    if end:
        g = g.filter(F.col("month") < F.lit(end).cast("date"))
    g = _percent_of(g, "month", "locations", "percent_of_locations")
    return g.filter(F.col("locations") > min_n)


def with_tiers(df: DataFrame, col: str, edges, labels, name: str) -> DataFrame:
    """Right-closed tier label and its rank (0 = lowest)."""
    return (df.withColumn(name, cut_right(col, edges, labels))
              .withColumn(f"{name}_rank", label_map(name, {lab: i for i, lab in enumerate(labels)})))


def arpu_headroom(cur: DataFrame, type_col: str, tier_col: str, value: str = "live_arr",
                  q: float = 0.95, uptake: float = 0.25, min_n: int = 100) -> DataFrame:
    """Per type x tier: target = p``q`` of ``value`` (rounded to 2),
    the rest below it, their median, potential = (target - median) *
    n_rest * uptake, and its share per location of the whole population."""
    c = cur.filter(F.col(type_col).isNotNull() & F.col(tier_col).isNotNull())
    keys = [type_col, tier_col]
    tgt = exact_quantiles(c, keys, value, {"target": q}).withColumn("target", F.round("target", 2))
    j = c.join(tgt, keys)
    rest = j.filter(F.col(value) < F.col("target"))
    med = exact_quantiles(rest, keys, value, {"median_rest": 0.5})
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_locations"),
                             F.count_if(F.col(value) < F.col("target")).alias("num_rest"),
                             F.min(f"{tier_col}_rank").alias("tier_rank"), F.first("target").alias("target"))
    total = cur.agg(F.count(F.lit(1)).alias("_all"))  # keyless aggregate: exactly one row
    out = (g.join(med, keys, "left").crossJoin(F.broadcast(total))
            .withColumn("potential_arr", (F.col("target") - F.col("median_rest")) * F.col("num_rest") * uptake)
            .withColumn("potential_arpu_impact", F.col("potential_arr") / F.col("_all"))
            .drop("_all"))
    return out.filter(F.col("num_locations") > min_n)


def top_rest_mix(cur: DataFrame, value: str, tier_col: str, tier_labels, q: float = 0.95) -> DataFrame:
    """Split a slice at p``q`` of ``value`` into top (>=) and rest (<);
    locations and percent per tier for both sides, empty tiers included."""
    spark = cur.sparkSession
    cut = exact_quantiles(cur, [], value, {"cut": q})
    # a single group -> exactly one row: broadcasting it is size-safe (a
    # shuffle join on a constant key would send every row to one task)
    j = cur.crossJoin(F.broadcast(cut))
    j = j.withColumn("side", F.when(F.col(value) >= F.col("cut"), "top").otherwise("rest"))
    counts = j.groupBy("side", tier_col).agg(F.count(F.lit(1)).alias("locations"))
    grid = spark.createDataFrame([(s, t) for s in ("top", "rest") for t in tier_labels],
                                 f"side string, {tier_col} string")
    g = grid.join(counts, ["side", tier_col], "left").fillna(0, subset=["locations"])
    tot = g.groupBy("side").agg(F.sum("locations").alias("_t"))
    return (g.join(tot, "side")
             .withColumn("percent", F.bround(F.coalesce(safe_div(100 * F.col("locations"), F.col("_t")),
                                                        F.lit(0.0)), 2))
             .drop("_t"))
