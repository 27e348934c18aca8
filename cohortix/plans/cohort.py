"""M43 daily cohort drivers and M44 period cohort growth.

M43 gives, per day and top account, the stocks of that day's snapshot (live
locations, live ARR, ARR of locations on their first order day) and the flows
attached to it: upsell and downsell of won opportunities by the sign of their
amounts, churned ARR split by churn reason.

* Locations roll up two levels (location -> parent -> grandparent) on the
  snapshot of their month.  Daily rows meet it by account and year (``_by_year``)
  and are added up per parent and day before they go up again.
* Opportunities and churned products are added up by (account, day) in one stream
  and then by (owner, day) before they meet the days; no day x opportunity product
  exists.
* ``levels=1`` attaches flows to the owner's direct children, ``levels=2`` rolls
  them up as the locations are: added up per parent and day, then on the chain of
  their month (``operators.joins.hierarchy``).

M44 evaluates periods (lengths x forward/lookback) of every month from an
account's first row on.  The cohort rows may be sparse: a stock is that of the
last row at or before the period's edge, a flow the difference of running sums
at the two edges.  Both come from one ``asof_stream``, a window over the
account's own rows and edges; no day grid, no range join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import div0
from ..operators.joins import asof_stream, hierarchy

STOCKS = ["live_saas_arr", "location_count"]
FLOWS = ["new_live_saas", "upsell_saas_arr", "downsell_saas_arr", "churned_saas_arr",
         "preventable_churn_arr", "non_preventable_churn_arr"]
OWNER = ["account_id", "customer_id", "rsm_id", "segment"]


@dataclass(frozen=True)
class CohortRules:
    """Values of the cohort report.  ``sign``: the amount whose sign tells
    upsell from downsell (it adds the software amount twice)."""

    live_status: str = "Live"
    excluded_resellers: tuple[str, ...] = ()
    excluded_owner_accounts: tuple[str, ...] = ()
    excluded_sellers: tuple[str, ...] = ()
    upsell_type: str = "Existing Business (Upsell)"
    payroll_record: str = "Payroll"
    existing_business: str = "Existing Customer"
    preventable_reasons: tuple[str, ...] = ("competitor",)
    sign: str = "software_mrr + hardware_cost + software_mrr"


def _month(c: str) -> Column:
    return F.trunc(c, "month")


def _by_year(snapshots: DataFrame, *attrs: str) -> DataFrame:
    """account_id, year, the ``attrs``, n: how many snapshot rows with these attrs
    the account has in each of the year's twelve months.

    Days meet a snapshot by (account_id, year) and their month's count: what is
    shuffled is a row per year and not one per month."""
    n = F.array(*[F.count_if(F.month("month") == k).cast("int") for k in range(1, 13)])
    firsts = snapshots.filter(F.col("month") == _month("month"))
    return firsts.groupBy("account_id", F.year("month").alias("year"), *attrs).agg(n.alias("n"))


def _on_day(days: DataFrame, by_year: DataFrame) -> DataFrame:
    """``days`` with the snapshot of their month: its attrs, month, and held, the
    number of its rows."""
    both = days.withColumn("year", F.year("dt")).join(by_year, ["account_id", "year"])
    return both.withColumns({"month": _month("dt"), "held": F.element_at("n", F.month("dt"))}).filter("held > 0")


def cohort_stocks(daily: DataFrame, snapshots: DataFrame, accounts: DataFrame, rules: CohortRules,
                  parents: DataFrame | None = None) -> DataFrame:
    """dt, owner attributes, location_count, live_saas_arr, new_live_saas.

    daily: account_id, dt (unique together), status, live_amount.  snapshots:
    month, account_id (unique together), customer_id, parent_account_id, rsm_id,
    segment, first_order_date.  accounts: account_id, reseller.  ``parents``: the
    snapshot rows of accounts that are a parent of any (all, if not given)."""
    parents = snapshots if parents is None else parents
    up = parents.select("month", "account_id", F.col("parent_account_id").alias("up"))
    dropped = accounts.filter(F.col("reseller").isin(*rules.excluded_resellers)).select("account_id")
    days = daily.join(dropped, "account_id", "left_anti") if rules.excluded_resellers else daily
    located = _on_day(days, _by_year(snapshots, "first_order_date", "parent_account_id").withColumnRenamed("parent_account_id", "up"))
    held = F.col("held")
    amount = F.col("live_amount") * held
    # sums of a parent's day first: what goes up another level is one row per
    # parent and day, and an account has one parent in a month
    sums = located.groupBy("dt", "month", "up").agg(
        F.sum(F.when(F.col("status") == rules.live_status, held).otherwise(0)).alias("n"), F.sum(amount).alias("live"),
        F.sum(F.when(F.col("dt") == F.col("first_order_date"), amount)).alias("new"))
    above = sums.withColumnRenamed("up", "account_id").join(up, ["month", "account_id"]).withColumnRenamed("up", "owner")
    sums = above.groupBy("dt", "month", "owner").agg(
        F.sum("n").alias("location_count"), (F.sum("live") * 12).alias("live_saas_arr"), (F.sum("new") * 12).alias("new_live_saas"))
    owner = parents.select("month", F.col("account_id").alias("owner"), F.col("customer_id"), "rsm_id", "segment")
    if rules.excluded_owner_accounts:
        owner = owner.filter(~F.col("owner").isin(*rules.excluded_owner_accounts))
    return sums.join(owner, ["month", "owner"]).select(
        "dt", F.col("owner").alias("account_id"), "customer_id", "rsm_id", "segment", "location_count", "live_saas_arr", "new_live_saas")


def account_flows(opps: DataFrame, status: DataFrame, rules: CohortRules) -> DataFrame:
    """account_id, dt, up, down, lost, opp: an account's day of qualifying
    opportunities (``opp`` 1) and its churned amount."""
    upsell = F.col("opp_type") == rules.upsell_type
    payroll = (F.col("record_type") == rules.payroll_record) & (F.col("business") == rules.existing_business)
    won = opps.filter(F.col("is_won") & ~F.col("owner_id").isin(*rules.excluded_sellers) & (upsell | payroll))
    sign, mrr = F.expr(rules.sign), F.coalesce("software_mrr", F.lit(0.0))
    up, down = F.when(upsell & (sign >= 0), mrr).otherwise(0.0), F.when(upsell & (sign < 0), mrr).otherwise(0.0)
    sold = won.select("account_id", F.col("close_date").alias("dt"), up.alias("up"), down.alias("down"),
                      F.lit(None).cast("double").alias("lost"), F.lit(1).alias("opp"))
    gone = status.filter((F.col("churn_date") == F.col("dt")) & F.col("first_order_date").isNotNull())
    zero = F.lit(0.0)
    churned = gone.select("account_id", "dt", zero.alias("up"), zero.alias("down"), F.col("saas_price").cast("double").alias("lost"), F.lit(0).alias("opp"))
    return sold.unionByName(churned).groupBy("account_id", "dt").agg(
        F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("lost").alias("lost"), F.max("opp").alias("opp"))


def owner_flows(flows: DataFrame, accounts: DataFrame, snapshots: DataFrame, rules: CohortRules, levels: int,
                parents: DataFrame | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(owner, dt, upsell, downsell, lost_p, lost_o), churned amounts by kind of
    reason; and per owner whether it has any qualifying opportunity and children
    of either kind (has_opp, any_p, any_o).

    ``parents`` as in ``cohort_stocks``.  ``stage`` saves a frame that is read more
    than once and gives it back as read (else it is computed again)."""
    reason = F.coalesce(F.lower("churn_reason"), F.lit("")).isin(*[r.lower() for r in rules.preventable_reasons])
    kinds = accounts.select("account_id", F.col("parent_account_id").alias("owner"), reason.alias("preventable"))
    p, known = F.col("preventable"), F.col("owner").isNotNull()

    def sums(df: DataFrame, *keys: str, held: Column) -> DataFrame:
        lost = F.col("lost") * held
        return df.groupBy(*keys).agg(F.sum(F.col("up") * held).alias("up"), F.sum(F.col("down") * held).alias("down"),
                                     F.sum(F.when(p, lost)).alias("lost_p"), F.sum(F.when(~p, lost)).alias("lost_o"), F.max("opp").alias("opp"))

    if levels == 1:
        days = sums(flows.join(kinds, "account_id").filter(known), "owner", "dt", held=F.lit(1))
        children = kinds.filter(known).groupBy("owner").agg(F.bool_or(p).alias("any_p"), F.bool_or(~p).alias("any_o"))
    else:
        links = (snapshots if parents is None else parents).select("month", "account_id", "parent_account_id")

        def owned(df: DataFrame) -> DataFrame:
            up = hierarchy(df, "account_id", "parent_account_id", "month", levels=2, links=links)
            return up.withColumnRenamed("parent_2", "owner").filter(known)

        # sums of a parent's day first, as the stocks are: few rows go up the chain
        by_year = stage(_by_year(snapshots, "parent_account_id").join(kinds.drop("owner"), "account_id"))
        below = sums(_on_day(flows, by_year), "month", "dt", "parent_account_id", held=F.col("held"))
        days = owned(below).groupBy("owner", "dt").agg(*[F.sum(c).alias(c) for c in ("up", "down", "lost_p", "lost_o")], F.max("opp").alias("opp"))
        seen = by_year.groupBy("year", "parent_account_id", "preventable").agg(
            F.array(*[F.max(F.element_at("n", k)) for k in range(1, 13)]).alias("n"))
        seen = seen.select("year", "parent_account_id", "preventable", F.posexplode("n").alias("k", "held")).filter("held > 0")
        children = owned(seen.withColumn("month", F.make_date("year", F.col("k") + 1, F.lit(1)))).groupBy("owner").agg(
            F.bool_or(p).alias("any_p"), F.bool_or(~p).alias("any_o"))
    days = stage(days)
    opp = days.groupBy("owner").agg((F.max("opp") == 1).alias("o"))
    kinds = opp.join(children, "owner", "full").select("owner", *[F.coalesce(c, F.lit(False)).alias(n) for c, n in (
        ("o", "has_opp"), ("any_p", "any_p"), ("any_o", "any_o"))])
    return days.select("owner", "dt", (F.col("up") * 12).alias("upsell_saas_arr"), (F.col("down") * 12).alias("downsell_saas_arr"),
                       (F.col("lost_p") * 12).alias("lost_p"), (F.col("lost_o") * 12).alias("lost_o")), stage(kinds)


def cohort_drivers(daily: DataFrame, snapshots: DataFrame, accounts: DataFrame, opps: DataFrame, status: DataFrame,
                   rules: CohortRules = CohortRules(), levels: int = 1, parents: DataFrame | None = None,
                   stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row per day and top account with a daily row below it.

    accounts: account_id, parent_account_id, reseller, churn_reason.  opps:
    account_id, close_date, is_won, owner_id, opp_type, record_type, business,
    software_mrr, hardware_cost.  status: account_id, dt, saas_price,
    churn_date, first_order_date (a row per product and day).

    Nulls follow the report: upsell and downsell are 0 on other days for accounts
    with any qualifying opportunity and null for the rest; a churn kind is 0 when
    the account has children of the other kind only, null without churn."""
    stocks = cohort_stocks(daily, snapshots, accounts, rules, parents)
    return with_flows(stocks, *owner_flows(account_flows(opps, status, rules), accounts, snapshots, rules, levels, parents, stage))


def with_flows(stocks: DataFrame, sums: DataFrame, kinds: DataFrame) -> DataFrame:
    """The report's rows of ``cohort_stocks`` and ``owner_flows``."""
    own = F.col("account_id")
    out = (stocks
           .join(sums.withColumnRenamed("owner", "account_id"), ["account_id", "dt"], "left")
           .join(kinds.withColumnRenamed("owner", "account_id"), "account_id", "left"))
    zero = F.lit(0.0)
    other = F.coalesce("any_o", F.lit(True))        # no children: one row of the other kind
    return out.select(
        "dt", own, "customer_id", "rsm_id", "segment", "location_count", "live_saas_arr", "new_live_saas",
        *[F.when(F.col("has_opp"), F.coalesce(c, zero)).alias(c) for c in ("upsell_saas_arr", "downsell_saas_arr")],
        F.when(F.col("lost_p").isNotNull() | F.col("lost_o").isNotNull(),
               F.coalesce("lost_p", zero) + F.coalesce("lost_o", zero)).alias("churned_saas_arr"),
        F.when(other, F.coalesce("lost_p", zero)).otherwise(F.col("lost_p")).alias("preventable_churn_arr"),
        F.when(F.coalesce("any_p", F.lit(False)), F.coalesce("lost_o", zero)).otherwise(F.col("lost_o"))
        .alias("non_preventable_churn_arr"))


def period_growth(cohort: DataFrame, as_of: str, lengths: tuple[int, ...] = (30, 60, 90, 180, 270, 365)) -> DataFrame:
    """Growth per month, length and direction over all accounts that have live
    locations at the period's start.

    cohort: account_id, dt (unique together), STOCKS, FLOWS; rows may be sparse.
    A period that ends after ``as_of`` ends on the day before it (its nominal
    length stays; ``effective_days`` tells the real one).  A missing flow is 0."""
    a = F.lit(as_of).cast("date")
    keys = ["month", "period_start", "period_end", "daysinperiod", "period_type"]
    d = cohort.select("account_id", "dt", *STOCKS, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FLOWS])
    d = d.withColumn("_first", F.min("dt").over(Window.partitionBy("account_id")))

    def period(month: Column, n: int, kind: str) -> Column:
        start = month if kind == "forward" else F.date_sub(F.last_day(month), n)
        end = F.date_add(month, n) if kind == "forward" else F.last_day(month)
        return F.struct(month.alias("month"), start.alias("period_start"), F.when(end > a, F.date_sub(a, 1)).otherwise(end).alias("period_end"),
                        F.lit(n).alias("daysinperiod"), F.lit(kind).alias("period_type"))

    # the account's first row brings all its periods: the cohort rows are read once
    months = F.sequence(F.trunc("_first", "month"), F.greatest(F.trunc(a, "month"), F.trunc("_first", "month")), F.expr("INTERVAL 1 MONTH"))
    every = F.flatten(F.transform(months, lambda m: F.array(*[period(m, n, k) for k in ("forward", "lookback") for n in lengths])))
    # no stock before the first row; the cut at as_of may leave no day
    every = F.filter(every, lambda p: (p["month"] <= a) & (p["period_start"] <= p["period_end"]) & (p["period_start"] >= F.col("_first")))
    edges = F.flatten(F.transform(every, lambda p: F.array(
        F.struct(p["period_start"].alias("dt"), F.lit(1).alias("probe"), p.alias("mine")),
        F.struct(p["period_end"].alias("dt"), F.lit(1).alias("probe"), p.alias("mine")))))
    own = F.array(F.struct(F.col("dt").alias("dt"), F.lit(0).alias("probe"), F.lit(None).alias("mine")))
    d = d.withColumn("e", F.explode(F.when(F.col("dt") == F.col("_first"), F.concat(own, edges)).otherwise(own)))
    row = F.col("e.probe") == 0
    both = d.select("account_id", F.col("e.dt").alias("dt"), F.col("e.probe").alias("_probe"), F.col("e.mine").alias("_mine"),
                    F.when(row, F.struct(F.col("dt").alias("t"), *STOCKS, *FLOWS)).alias("_row"),
                    *[F.when(row, F.col(f)).alias(f"_r_{f}") for f in FLOWS])
    seen = asof_stream(both, ["account_id"], "dt", STOCKS + FLOWS, FLOWS)
    at_start, at_end = F.col("dt") == F.col("period_start"), F.col("dt") == F.col("period_end")
    # a flow counts from the start day on: the running sum there, less that day's own row
    before = {f: F.col(f"cum_{f}") - F.when(F.col("row_dt") == F.col("dt"), F.col(f)).otherwise(0.0) for f in FLOWS}
    # a period of one day has two edges on it
    per = seen.groupBy("account_id", *keys).agg(
        F.max(F.when(at_start, F.col("live_saas_arr"))).alias("start_saas"),
        F.max(F.when(at_start, F.col("location_count"))).alias("start_locations"),
        F.max(F.when(at_end, F.col("live_saas_arr"))).alias("end_saas"),
        *[(F.max(F.when(at_end, F.col(f"cum_{f}"))) - F.max(F.when(at_start, before[f]))).alias(f) for f in FLOWS])
    g = per.filter("start_locations > 0").groupBy(*keys).agg(
        F.round(F.sum("start_saas"), 2).alias("period_start_saas"), F.round(F.sum("end_saas"), 2).alias("period_end_saas"),
        *[F.round(F.sum(f), 2).alias(n) for n, f in (("new_location", "new_live_saas"), ("upsell", "upsell_saas_arr"),
                                                     ("downsell", "downsell_saas_arr"), ("churn", "churned_saas_arr"))])
    growth = div0(F.col("period_start_saas") + F.col("new_location") + F.col("upsell") +
                  F.col("downsell") - F.col("churn"), F.col("period_start_saas")) * 100
    return g.withColumns({"effective_days": F.datediff("period_end", "period_start"), "cohort_growth": F.round(growth, 2)})
