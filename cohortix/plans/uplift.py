"""Year-over-year volume growth and module-adoption uplift tests
(M24, M27-M32)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import quarter_start
from ..functions.nulls import row_sum, safe_div
from ..operators.joins import latest_rows, period_lookback
from ..operators.quantiles import quantile_sketches
from ..operators.stats import pooled_t, t_two_sided_p


def latest_customer(daily: DataFrame, customers: DataFrame, attrs: list[str]) -> DataFrame:
    """Attributes from each customer's latest snapshot day (two rows of that
    day give two), plus the quarter of the first order."""
    last = latest_rows(daily.select("customer_id", "dt", "status"), ["customer_id"], "dt")
    c = customers.select("customer_id", "first_order_date", *attrs)
    return (last.join(c, "customer_id", "left")
                .select("customer_id", F.md5(F.col("customer_id").cast("string")).alias("customer_key"),
                        F.col("dt").alias("latest_dt"), "status", *attrs,
                        quarter_start("first_order_date").alias("first_order_quarter")))


def counted_days(daily: DataFrame, customers: DataFrame, status: str = "Live") -> DataFrame:
    """Days of ``status`` after the quarter of the customer's first order."""
    return (daily.join(customers.select("customer_id", "first_order_date"), "customer_id")
            .filter((F.col("status") == status) & (F.col("first_order_date") < quarter_start("dt"))))


def quarter_sketches(daily: DataFrame, customers: DataFrame, k: int = 1024) -> DataFrame:
    """Sketches of the positive daily volumes per (customer, quarter), to be saved:
    years, segments or all customers are answered from them without the days."""
    d = counted_days(daily, customers).filter(F.col("volume") > 0)
    return quantile_sketches(d.withColumn("quarter", quarter_start("dt")), ["customer_id", "quarter"], "volume", k)


def quarter_volume(daily: DataFrame, customers: DataFrame, status: str = "Live") -> DataFrame:
    """Per (customer, quarter) of ``status`` days after the first-order
    quarter: total volume, active days and min/p25/median/p75/max over
    positive days (exact, linear interpolation)."""
    d = counted_days(daily, customers, status)
    pos = F.when(F.col("volume") > 0, F.col("volume"))
    return d.groupBy("customer_id", quarter_start("dt").alias("quarter")).agg(
        F.sum("volume").alias("gmv"),
        F.count_distinct(F.when(F.col("volume") > 0, F.col("dt"))).alias("active_days"),
        F.min(pos).alias("min_gmv_pd"), F.percentile(pos, 0.25).alias("p25_gmv_pd"),
        F.median(pos).alias("med_gmv_pd"), F.percentile(pos, 0.75).alias("p75_gmv_pd"),
        F.max(pos).alias("max_gmv_pd"))


def volume_yoy(qv: DataFrame, months: int = 12) -> DataFrame:
    """Quarter vs the same customer's quarter ``months`` earlier (inner):
    total, per-active-day and median-day growth with percentages (bround 2)."""
    j = period_lookback(qv.select("customer_id", "quarter", "gmv", "active_days", "med_gmv_pd"),
                        ["customer_id"], "quarter", ["gmv", "active_days", "med_gmv_pd"], months, "_ly")
    j = j.withColumns({"gmv_pd": safe_div("gmv", "active_days"),
                       "gmv_pd_ly": safe_div("gmv_ly", "active_days_ly")})
    growth = {}
    for name, now, last in [("gmv", "gmv", "gmv_ly"), ("gmv_pd", "gmv_pd", "gmv_pd_ly"),
                            ("med_gmv_pd", "med_gmv_pd", "med_gmv_pd_ly")]:
        g = F.col(now) - F.col(last)
        growth[f"{name}_growth"] = g
        growth[f"{name}_growth_pct"] = F.bround(safe_div(g * 100, F.col(last)), 2)
    return j.withColumns(growth)


def growth_panel(vy: DataFrame, my: DataFrame, modules: list[str],
                 guest: list[str]) -> DataFrame:
    """Growth joined to module changes (inner); guest count = row-wise
    sum of the guest modules; per-module change with null -> 0."""
    j = vy.join(my, ["customer_id", "quarter"], "inner")
    j = j.withColumns({"guest_count": row_sum(*guest),
                       "guest_count_ly": row_sum(*[f"{g}_ly" for g in guest])})
    return j.withColumns({f"{m}_change": F.coalesce(F.col(m) - F.col(f"{m}_ly"), F.lit(0))
                          for m in modules + ["guest_count"]})


def _stats(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Counts, median, mean and variance of ``growth`` per key; ``df`` has a
    customer once per key."""
    return df.groupBy(*keys).agg(
        F.count("customer_id").alias(f"n_{tag}"), F.count("growth").alias(f"k_{tag}"),
        F.median("growth").alias(f"med_{tag}"), F.avg("growth").alias(f"mean_{tag}"),
        F.var_samp("growth").alias(f"var_{tag}"))


def _compared(s: DataFrame) -> DataFrame:
    t = pooled_t(F.col("k_pos"), F.col("mean_pos"), F.col("var_pos"),
                 F.col("k_neg"), F.col("mean_neg"), F.col("var_neg"))
    diff = F.col("med_pos") - F.col("med_neg")
    return s.withColumns({"t_stat": t, "dof": F.col("k_pos") + F.col("k_neg") - 2,
                          "typical_growth_diff": diff,
                          "growth_rate_diff": F.bround(safe_div(diff * 100, F.col("med_neg")), 2)})


def _two_group_summary(df: DataFrame, keys: list[str], positive) -> DataFrame:
    """Slices that have both groups, compared; one aggregation."""
    g = _stats(df.withColumn("_pos", positive), [*keys, "_pos"], "x")
    pick = lambda c, side: F.max(F.when(F.col("_pos") == F.lit(side), F.col(f"{c}_x")))
    s = g.groupBy(*keys).agg(*[pick(c, side).alias(f"{c}_{tag}") for c in ("n", "k", "med", "mean", "var")
                               for side, tag in ((True, "pos"), (False, "neg"))])
    return _compared(s.filter(F.col("n_pos").isNotNull() & F.col("n_neg").isNotNull()))


def adopter_uplift(panel: DataFrame, modules: list[str], growth: str = "gmv_pd_growth_pct",
                   band: tuple[float, float] = (-50.0, 200.0), with_p: bool = True) -> DataFrame:
    """Per module and quarter, customers who added the module (change
    > 0) vs those who did not: counts, median growth, differences, pooled
    t statistic and its two-sided p (bround 4).  All modules in one job:
    the panel is unpivoted to (module, change) rows."""
    p = panel.filter((F.col(growth) > band[0]) & (F.col(growth) < band[1]))
    long = p.select("customer_id", "quarter", F.col(growth).alias("growth"),
                    F.explode(F.array(*[F.struct(F.lit(m).alias("module"),
                                                 F.col(f"{m}_change").cast("double").alias("change"))
                                        for m in modules])).alias("u")).select(
        "customer_id", "quarter", "growth", "u.module", "u.change")
    s = _two_group_summary(long, ["module", "quarter"], F.coalesce(F.col("change") > 0, F.lit(False)))
    return _finish(s, ["module", "quarter"], with_p)


def _finish(s: DataFrame, keys: list[str], with_p: bool) -> DataFrame:
    cols = [*keys, F.col("n_pos").alias("n_added"), F.col("n_neg").alias("n_not_added"),
            F.round("med_pos", 6).alias("added_typical_growth"),
            F.round("med_neg", 6).alias("not_added_typical_growth"),
            F.round("typical_growth_diff", 6).alias("typical_growth_diff"), "growth_rate_diff",
            F.round("t_stat", 4).alias("t_stat"), "dof"]
    if with_p:
        cols.append(F.bround(t_two_sided_p(F.col("t_stat"), F.col("dof")), 4).alias("p_value"))
    return s.select(*cols)


def bundle_uplift(panel: DataFrame, flags: dict[str, str], quarters: list[str] | None,
                  growth: str = "gmv_pd_growth_pct", band: tuple[float, float] = (-50.0, 200.0),
                  min_n: int = 500, with_p: bool = True) -> DataFrame:
    """M31/M32, per quarter: customers who hold any studied module now ('Had')
    against those who hold none.

    A customer's bundle is the modules held both now and a year ago, joined
    with '+'.  Slices: each bundle label with more than ``min_n`` customers,
    taking its customers and those without a stable bundle ('' -- who may hold
    a module now), and 'All', taking every customer.

    Who holds none is in every slice of the quarter, so that group is
    aggregated once per quarter; only holders without a stable bundle are
    repeated, once per slice of their quarter."""
    keep = (F.col(growth) > band[0]) & (F.col(growth) < band[1])
    if quarters is not None:     # None: every quarter of the panel
        keep = keep & F.col("quarter").isin(*[F.lit(q).cast("date") for q in quarters])
    stable = [F.when((F.col(c) > 0) & (F.col(f"{c}_ly") > 0), F.lit(name)) for name, c in flags.items()]
    now = F.lit(False)
    for c in flags.values():
        now = now | F.coalesce(F.col(c) > 0, F.lit(False))
    p = panel.filter(keep).select("customer_id", "quarter", F.col(growth).alias("growth"), now.alias("had"),
                                  F.concat_ws("+", *stable).alias("bundle"))
    big = p.groupBy("quarter", "bundle").agg(F.count("customer_id").alias("_n")).filter(
        F.col("_n") > min_n).select("quarter", "bundle")
    none_ = _stats(p.filter(~F.col("had")), ["quarter"], "neg")
    holders = p.filter("had")
    # the slices of a quarter as one array: holders without a bundle go to each
    slices = big.groupBy("quarter").agg(F.collect_set("bundle").alias("_slices"))
    at = holders.join(slices, "quarter", "left")
    listed = F.coalesce("_slices", F.array().cast("array<string>"))
    own = F.when(F.col("bundle") == "", listed).otherwise(F.array_intersect(listed, F.array("bundle")))
    had = at.select("customer_id", "quarter", "growth", F.explode(F.concat(own, F.array(F.lit("All")))).alias("bundle"))
    s = _compared(_stats(had, ["quarter", "bundle"], "pos").join(none_, "quarter"))
    return _finish(s, ["quarter", "bundle"], with_p)
