"""Subscription metrics: monthly panels, +12-month twins and retention.

retention(panel, kind)      M14  net / gross retention by month
retention_by_year(ret)      M15  sum(end) / sum(start) per calendar year
monthly_qa(panel, year)     M16  monthly sums for one year
month_end_subscription      M3   month-end status row per account
monthly_volume              M4   monthly and annualised volume
monthly_payments            M5   live-day payments, tenure number, margin bps
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import is_month_end, month_start
from ..functions.nulls import safe_div
from ..operators.joins import latest_rows, period_offset

# measure columns of a retention panel -> output names
RETENTION_MEASURES = {
    "pos_saas_arr": "live_pos_saas",
    "ec_saas_arr": "live_ec_saas",
    "payments_arr": "payments_arr",
    "annual_gmv": "gmv",
    "annual_gpv": "gpv",
}


def with_twelve_month_twin(panel: DataFrame, keys: list[str], time_col: str = "month",
                           measures: list[str] | None = None, months: int = 12) -> DataFrame:
    """Attach ``<m>_12`` (same keys, ``months`` later, 0 when absent)."""
    measures = measures or list(RETENTION_MEASURES)
    return period_offset(panel, keys, time_col, measures, months=months)


def retention(panel: DataFrame, kind: str = "net", time_col: str = "month") -> DataFrame:
    """Retention by ``time_col`` from a panel holding ``m`` and ``m_12``.

    Gross caps each row's future value at its current value (row-wise min
    that skips nulls).  Ratios are future/current sums; a zero denominator
    gives null.
    """
    if kind not in ("net", "gross"):
        raise ValueError("kind must be 'net' or 'gross'")
    aggs = []
    for m, name in RETENTION_MEASURES.items():
        now, fut = F.col(m), F.col(m + "_12")
        if kind == "gross":
            fut = F.least(now, fut)
        aggs += [F.coalesce(F.sum(now), F.lit(0.0)).alias(name),
                 F.coalesce(F.sum(fut), F.lit(0.0)).alias(name + "_12")]
    g = panel.groupBy(time_col).agg(*aggs)
    start = F.col("live_pos_saas") + F.col("live_ec_saas")
    end = F.col("live_pos_saas_12") + F.col("live_ec_saas_12")
    out = (g.withColumn("starting_live_saas", start).withColumn("ending_live_saas", end)
            .withColumn("saas_rr", safe_div("ending_live_saas", "starting_live_saas"))
            .withColumn("payments_rr", safe_div("payments_arr_12", "payments_arr"))
            .withColumn("gmv_rr", safe_div("gmv_12", "gmv"))
            .withColumn("gpv_rr", safe_div("gpv_12", "gpv")))
    money = [c for c in out.columns if c != time_col and not c.endswith("_rr")]
    return out.select(time_col, *[F.round(c, 2).alias(c) for c in money],
                      *[F.round(c, 6).alias(c) for c in ("saas_rr", "payments_rr", "gmv_rr", "gpv_rr")])


def retention_by_year(ret: DataFrame, before: str, start_col: str = "starting_live_saas",
                      end_col: str = "ending_live_saas", time_col: str = "month") -> DataFrame:
    """Per calendar year: sum(end) / sum(start) over months before ``before``."""
    return (ret.filter(F.col(time_col) < F.lit(before).cast("date"))
               .groupBy(F.year(time_col).alias("year"))
               .agg(F.round(F.sum(start_col), 2).alias("start_sum"),
                    F.round(F.sum(end_col), 2).alias("end_sum"),
                    F.round(safe_div(F.sum(end_col), F.sum(start_col)), 6).alias("retention")))


def monthly_qa(panel: DataFrame, year: int, time_col: str = "month",
               measures: list[str] | None = None) -> DataFrame:
    measures = measures or list(RETENTION_MEASURES)
    return (panel.filter(F.year(time_col) == year).groupBy(time_col)
                 .agg(*[F.round(F.sum(m), 2).alias(m) for m in measures]))


def month_end_subscription(daily: DataFrame, customers: DataFrame) -> DataFrame:
    """M3: the snapshot row of each month's last day per account, with
    go-live/booked-this-month flags, live/backlog ARR and the +12 key."""
    last = daily.filter(is_month_end("dt")).withColumn("month", month_start("dt"))
    c = customers.select("customer_id", "first_order_date")
    return (last.join(c, "customer_id", "left").select(
        "customer_id", "month", "status",
        (month_start("first_order_date") == F.col("month")).alias("go_live_this_month"),
        (F.col("status") == "Backlog").alias("booked_this_month"),
        F.round(F.when(F.col("status") == "Live", F.col("volume") * 12).otherwise(0.0), 2).alias("live_arr"),
        F.round(F.when(F.col("status") == "Backlog", F.col("volume") * 12).otherwise(0.0), 2).alias("backlog_arr"),
        F.add_months("month", 12).alias("month_12")))


def monthly_volume(daily: DataFrame) -> DataFrame:
    """M4: sum and annualised sum of volume by account-month."""
    return (daily.groupBy("customer_id", month_start("dt").alias("month"))
                 .agg(F.round(F.sum("volume"), 2).alias("monthly_volume"),
                      F.round(F.sum("volume") * 12, 2).alias("annual_volume")))


def monthly_payments(daily: DataFrame, status: str = "Live") -> DataFrame:
    """M5: payments on ``status`` days: sums, x12, tenure month number (1 =
    first payment month of the account) and margin in basis points."""
    g = (daily.filter(F.col("status") == status)
              .groupBy("customer_id", month_start("dt").alias("month"))
              .agg(F.sum("volume").alias("volume"), F.sum("margin").alias("margin"),
                   F.sum("tx").alias("tx")))
    # the window runs on the account-month aggregate: at most one row per
    # month per account, so a hot account cannot overload one task
    w = Window.partitionBy("customer_id").orderBy("month")
    return g.select(
        "customer_id", "month", F.round("volume", 2).alias("volume"),
        F.round(F.col("volume") * 12, 2).alias("annual_volume"),
        F.round("margin", 2).alias("margin"), F.round(F.col("margin") * 12, 2).alias("annual_margin"),
        "tx", F.row_number().over(w).alias("month_num"),
        F.round(safe_div(F.col("margin"), F.col("volume")) * 10000, 4).alias("margin_bps"))


# =====================================================================
# M1/M2: id lists and recurring payroll revenue by parent
# =====================================================================
def explode_ids(df: DataFrame, col: str, key: str, delims: str = " ;:,/",
                must_contain: str = "-") -> DataFrame:
    """M1: one row per distinct (id, key) from a delimited id list."""
    pattern = "[" + "".join("\\" + c if c in "\\^]-" else c for c in delims) + "]+"
    return (df.select(F.explode(F.split(F.col(col), pattern)).alias("guid"), F.col(key))
              .filter(F.col("guid").contains(must_contain))
              .distinct())


def recurring_parent_month(invoices: DataFrame, id_map: DataFrame, accounts: DataFrame,
                           start: str, allow_fanout: bool = False) -> DataFrame:
    """M2: recurring invoice totals x12 by parent and month from ``start``.

    invoices: guid, check_date, total, recurring (bool); id_map: guid,
    account_id; accounts: account_id, parent_id.  By default each
    (guid, parent) pair counts once, so a guid listed on several accounts of
    one parent is not multiplied."""
    gp = id_map.join(accounts, "account_id").select("guid", "parent_id")
    if not allow_fanout:
        gp = gp.distinct()
    # pre-aggregate to (guid, month) before the join: a guid with a large
    # share of the invoices reaches the join as one row per month
    inv = (invoices.filter(F.col("recurring") & (month_start("check_date") >= F.lit(start).cast("date")))
                   .groupBy("guid", month_start("check_date").alias("month"))
                   .agg(F.sum(F.col("total") * 12).alias("arr")))
    return (inv.join(gp, "guid").groupBy("parent_id", "month")
               .agg(F.round(F.sum("arr"), 2).alias("ec_saas_arr")))


# =====================================================================
# M6: tiered revenue share
# =====================================================================
from dataclasses import dataclass  # noqa: E402


@dataclass(frozen=True)
class ShareSchedule:
    """Revenue-share contract.  Defaults are the contract's fixed values:
    before ``first_change`` the first source earns 0.65; from then on its
    rate steps with the month's count of transacting accounts (<= 2000:
    0.78, <= 5000: 0.81, <= 10000: 0.84, <= 20000: 0.87, above: 0.90).
    From ``second_change`` the second source earns 0.17, the fourth 0.08,
    and the third steps with the month's transactions (<= 200000: 0.15,
    <= 400000: 0.10, above: 0.05); before that both are 0."""
    first_change: str = "2021-03-01"
    before_rate: float = 0.65
    tds_edges: tuple = (2000, 5000, 10000, 20000)
    tds_rates: tuple = (0.78, 0.81, 0.84, 0.87, 0.90)
    second_change: str = "2021-10-01"
    dd_rate: float = 0.17
    ue_rate: float = 0.08
    gh_edges: tuple = (200000, 400000)
    gh_rates: tuple = (0.15, 0.10, 0.05)


def _step(x, edges, rates):
    out = F.when(x <= edges[0], F.lit(rates[0]))
    for e, r in zip(edges[1:], rates[1:-1]):
        out = out.when(x <= e, F.lit(r))
    return out.otherwise(F.lit(rates[-1]))


def revenue_share(monthly: DataFrame, schedule: ShareSchedule = ShareSchedule()) -> DataFrame:
    """M6: monthly multipliers from month-level counts, joined back to the
    account-months; share ARR per source and their null-skipping total.
    monthly: customer_id, month, tds_tx, dd_tx, gh_tx, ue_tx."""
    m = F.col("month")
    c1, c2 = F.lit(schedule.first_change).cast("date"), F.lit(schedule.second_change).cast("date")
    rates = (monthly.groupBy("month").agg(
        F.sum(F.when(F.col("tds_tx") > 0, 1).otherwise(0)).alias("tds_cx"),
        F.sum("gh_tx").alias("gh_total"))
        .select("month",
                F.when(m < c1, F.lit(schedule.before_rate))
                 .otherwise(_step(F.col("tds_cx"), schedule.tds_edges, schedule.tds_rates)).alias("tds_mult"),
                F.when(m >= c2, F.lit(schedule.dd_rate)).otherwise(0.0).alias("dd_mult"),
                F.when(m >= c2, F.lit(schedule.ue_rate)).otherwise(0.0).alias("ue_mult"),
                F.when(m >= c2, _step(F.col("gh_total"), schedule.gh_edges, schedule.gh_rates))
                 .otherwise(0.0).alias("gh_mult")))
    # one row per month: bounded by the calendar, so the broadcast is size-safe
    j = monthly.join(F.broadcast(rates), "month", "left")
    srcs = ["tds", "dd", "gh", "ue"]
    for s in srcs:
        j = j.withColumn(f"{s}_rev_share_arr",
                         F.coalesce(F.col(f"{s}_tx") * F.col(f"{s}_mult"), F.lit(0.0)) * 12)
    total = sum(F.col(f"{s}_rev_share_arr") for s in srcs)
    return j.select("customer_id", "month", *[f"{s}_mult" for s in srcs],
                    *[F.round(f"{s}_rev_share_arr", 2).alias(f"{s}_rev_share_arr") for s in srcs],
                    F.round(total, 2).alias("rev_share_arr"))


# =====================================================================
# Location month, churn policy, parent month, proration, ARPU
# =====================================================================
LOC_MEASURES = ["pos_live_saas_arr_full_month", "payments_margin_arr_full_month", "annual_gmv",
                "annual_gpv", "live_count", "backlog_count", "go_live_count", "booked_count",
                "has_guest_saas"]


def location_month(facts: DataFrame, accounts: DataFrame,
                   schedule: ShareSchedule | None = None) -> DataFrame:
    """M7 from one customer-month fact table.

    facts: customer_id, month, status (the month's last status),
    pos_live_saas_arr, has_guest_saas, annual_gmv, annual_gpv,
    payments_margin_arr and tds/dd/gh/ue_tx (live days only; 0 when the
    month has no live day).  accounts: customer_id, parent_id,
    churn_reason, churn_date, first_order_date.  The revenue share (M6) is
    computed here from the same facts when ``schedule`` is given (else
    facts must carry ``rev_share_arr``).  One aggregation feeds everything:
    no re-aggregation of the daily data per measure.
    """
    if schedule is not None:
        rs = revenue_share(facts.select("customer_id", "month", "tds_tx", "dd_tx", "gh_tx", "ue_tx"), schedule)
        facts = facts.join(rs.select("customer_id", "month", "rev_share_arr"), ["customer_id", "month"], "left")
    a = accounts.select("customer_id", "parent_id", "churn_reason",
                        F.col("first_order_date").alias("fod"),
                        month_start("churn_date").alias("churn_month"))
    j = (facts.join(a, "customer_id", "left")
              .fillna(0.0, subset=["annual_gmv", "annual_gpv", "payments_margin_arr"]))
    go_live = month_start("fod") == F.col("month")
    booked = F.col("status") == "Backlog"
    status = F.when(go_live, F.lit("Go-Live")).otherwise(F.col("status"))
    live_like = status.isin("Live", "Go-Live") & (F.col("fod") < F.col("month"))
    rev = F.coalesce("rev_share_arr", F.lit(0.0))
    saas = F.col("pos_live_saas_arr") + rev
    j = j.select(
        "customer_id", "parent_id", "month", F.add_months("month", 12).alias("month_12"),
        status.alias("status"), "churn_reason", "churn_month", "fod",
        F.when(status == "Live", 1).otherwise(0).alias("live_count"),
        F.when(status == "Backlog", 1).otherwise(0).alias("backlog_count"),
        F.when(go_live, 1).otherwise(0).alias("go_live_count"),
        F.when(booked, 1).otherwise(0).alias("booked_count"),
        saas.alias("pos_live_saas_arr"), rev.alias("rev_share_arr"),
        F.when(live_like, saas).otherwise(0.0).alias("pos_live_saas_arr_full_month"),
        F.when(live_like, F.col("payments_margin_arr")).otherwise(0.0).alias("payments_margin_arr_full_month"),
        "annual_gmv", "annual_gpv", "has_guest_saas", *[c for c in ("pos_backlog_saas_arr",) if c in facts.columns])
    # status 12 months later is read before the churn relabel (source order)
    j = period_offset(j.withColumnRenamed("live_count", "is_live"), ["customer_id"], "month",
                      ["status", "is_live"], 12, "_12", fill=None)
    j = j.withColumnRenamed("is_live", "live_count")
    return j.withColumn("status", F.when(F.col("month") >= F.col("churn_month"), F.lit("Churn"))
                        .otherwise(F.col("status")))


def month_facts(daily: DataFrame, status_of=None) -> DataFrame:
    """The customer-month fact table of :func:`location_month` in one
    aggregation of the daily snapshot (daily: customer_id, dt, status,
    volume, margin, gpv, tds/dd/gh/ue_tx).  ``status_of``: the label of a
    status code, when the snapshot brings ``status_code``."""
    live = F.col("status") == "Live"
    lsum = lambda c: F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0))
    # the month's last status is taken by its integer code when present
    # (fixed-width buffer -> hash aggregation), else by the label
    last = (F.max_by("status_code", "dt") if status_of is not None
            else F.max_by("status", "dt"))
    g = daily.groupBy("customer_id", month_start("dt").alias("month")).agg(
        last.alias("_last"),
        (lsum("volume") * 12).cast("double").alias("pos_live_saas_arr"),
        (F.coalesce(F.sum(F.when(F.col("status") == "Backlog", F.col("volume"))), F.lit(0)) * 12).cast("double")
        .alias("pos_backlog_saas_arr"),
        F.sum("gh_tx").alias("has_guest_saas"),
        (F.sum("volume") * 12).alias("annual_gmv"), (F.sum("gpv") * 12).alias("annual_gpv"),
        (lsum("margin") * 12).cast("double").alias("payments_margin_arr"),
        *[lsum(c).cast("long").alias(c) for c in ("tds_tx", "dd_tx", "gh_tx", "ue_tx")])
    if status_of is not None:      # the labels of the codes: a row per status
        return g.withColumn("status", status_of(F.col("_last"))).drop("_last")
    return g.withColumnRenamed("_last", "status")


def apply_churn_policy(loc: DataFrame, policy: str = "keep") -> DataFrame:
    """M8: 'keep' rows whose status is Backlog/Live/Go-Live; 'remove' also
    drops rows churned 12 months later or churned to a competitor (null
    reasons and statuses count as different)."""
    keep = F.col("status").isin("Backlog", "Live", "Go-Live")
    if policy == "keep":
        return loc.filter(keep)
    if policy == "remove":
        return loc.filter(keep & ~F.col("status_12").eqNullSafe("Churn") &
                          ~F.col("churn_reason").eqNullSafe("Competitor"))
    raise ValueError("policy must be 'keep' or 'remove'")


def parent_month(loc: DataFrame, ec_parent: DataFrame, parents: DataFrame) -> DataFrame:
    """M9.  loc: M8 rows; ec_parent: parent_id, month, ec_saas_arr (M2);
    parents: parent_id, parent_name, market_segment, parent_first_go_live."""
    g = (loc.filter(F.col("parent_id").isNotNull())
            .groupBy("parent_id", "month").agg(*[F.sum(m).alias(m) for m in LOC_MEASURES]))
    g = (g.join(parents, "parent_id", "inner").join(ec_parent, ["parent_id", "month"], "left")
          .fillna(0.0, subset=["ec_saas_arr"]))
    measures = LOC_MEASURES + ["ec_saas_arr"]
    g = period_offset(g, ["parent_id"], "month", measures, 12, "_12", 0,
                      attrs=["parent_name", "market_segment", "parent_first_go_live"])
    g = g.filter(F.col("parent_first_go_live").isNotNull() & (F.col("month") > F.col("parent_first_go_live")))
    ffm = F.trunc(F.add_months("parent_first_go_live", 1), "month")
    return g.select("parent_id", "parent_name", "market_segment", "parent_first_go_live", "month",
                    F.add_months("month", 12).alias("month_12"), *measures,
                    *[f"{m}_12" for m in measures], ffm.alias("first_full_month"),
                    F.year(ffm).alias("cohort_year"), F.trunc("month", "quarter").alias("quarter"))


def location_month_prorated(loc_keep: DataFrame, parent: DataFrame, accounts: DataFrame) -> DataFrame:
    """Location rows (live only) with the parent's EC ARR split evenly
    over the parent's live locations, now and 12 months later.
    accounts: customer_id, parent_id, market_segment, parent_first_go_live."""
    measures = LOC_MEASURES + ["rev_share_arr"]
    lm = period_offset(loc_keep.select("customer_id", "month", *measures), ["customer_id"], "month",
                       measures, 12, "_12", 0)
    lm = (lm.join(accounts, "customer_id", "left").filter(F.col("live_count") > 0)
            .join(parent.select("parent_id", "month", "ec_saas_arr", "ec_saas_arr_12"),
                  ["parent_id", "month"], "left"))
    sib = lm.groupBy("parent_id", "month").agg(F.sum("live_count").alias("live_locations"),
                                               F.sum("live_count_12").alias("live_locations_12"))
    lm = lm.join(sib, ["parent_id", "month"], "left")
    lm = (lm.withColumn("ec_saas_arr", F.coalesce(safe_div("ec_saas_arr", "live_locations"), F.lit(0.0)))
            .withColumn("ec_saas_arr_12", F.coalesce(safe_div("ec_saas_arr_12", "live_locations_12"), F.lit(0.0))))
    lm = lm.filter(F.col("month") > F.col("parent_first_go_live"))
    return lm.withColumn("quarter", F.trunc("month", "quarter"))


def recent(df: DataFrame, date_col: str, as_of: str, months: int) -> DataFrame:
    """Rows dated within the ``months`` before ``as_of`` (a trailing window)."""
    return df.filter(F.col(date_col) >= F.add_months(F.lit(as_of).cast("date"), -months))


def arpu_by_line(loc: DataFrame, nps: DataFrame, segment: str, since: str, surveys_as_of: str,
                 survey_months: int = 6) -> DataFrame:
    """Per month and product line (POS, POS + Guest, POS + EC,
    POS + Guest + EC, plus Total): locations, ARR sums, NPS and ARPUs.
    nps: customer_id, survey_date, nps_score (0-10) of the latest survey; older
    ones than the trailing window do not count."""
    nps = recent(nps, "survey_date", surveys_as_of, survey_months).select("customer_id", "nps_score")
    d = (loc.filter((F.col("month") >= F.lit(since).cast("date")) & (F.col("market_segment") == segment))
            .join(nps, "customer_id", "left"))
    guest, ec = F.col("has_guest_saas") > 0, F.col("ec_saas_arr") > 0
    line = (F.when(guest & ec, "POS + Guest + EC").when(guest, "POS + Guest").when(ec, "POS + EC")
             .otherwise("POS"))
    s = F.col("nps_score")
    d = d.withColumn("line", line)
    from ..operators.aggregates import with_total
    g = with_total(d, ["month"], "line", [
        F.count("customer_id").alias("locations"),
        F.sum("payments_margin_arr_full_month").alias("payments_arr"),
        F.sum("pos_live_saas_arr_full_month").alias("pos_saas"),
        F.sum("ec_saas_arr").alias("ec_saas"),
        F.count_if(s.isin(9, 10)).alias("promoters"),
        F.count_if(s.between(0, 6)).alias("detractors"),
        F.count(s).alias("surveys")])
    # ARPUs divide the rounded (cent) sums: both inputs are exact decimals,
    # and IEEE division then gives the same double on any engine, without a
    # second rounding whose ties (sums / 8 end in ...5) would be ambiguous
    rp, rs, re_ = F.round("payments_arr", 2), F.round("pos_saas", 2), F.round("ec_saas", 2)
    pay = F.try_divide(rp, F.col("locations"))
    saas = F.try_divide(rs + re_, F.col("locations"))
    return g.select(
        "month", "line", "locations", rp.alias("payments_arr"), rs.alias("pos_saas"), re_.alias("ec_saas"),
        F.try_divide((F.col("promoters") - F.col("detractors")) * 100, F.col("surveys")).alias("nps"),
        "surveys", pay.alias("payments_arpu"), saas.alias("saas_arpu"), (pay + saas).alias("total_arpu"))


# =====================================================================
# Investor sets and account timeline
# =====================================================================
INVESTOR_STATUSES = ("Backlog", "Go-Live", "Live", "Churn", "Canceled Contract")
INVESTOR_METRICS = ("backlog_saas", "pre_live_saas", "live_saas", "monthly_gmv", "monthly_payments_margin")


def investor_long(loc: DataFrame) -> DataFrame:
    """M12 long: account-month rows of the reported statuses.  The month of the
    first order is labelled 'Go-Live Month'; the booked amount is the backlog;
    monthly SaaS counts as pre-live while in backlog and as live otherwise; volume and payments margin count
    only in the go-live month and while live."""
    status = F.when(month_start("fod") == F.col("month"), F.lit("Go-Live Month")).otherwise(F.col("status"))
    backlog, paying = F.col("status") == "Backlog", F.col("status").isin("Go-Live Month", "Live")
    monthly = lambda c: F.round(c, 2) / 12
    return (loc.filter(F.col("status").isin(*INVESTOR_STATUSES)).withColumn("status", status).select(
        "customer_id", "parent_id", "month", "status", monthly("pos_backlog_saas_arr").alias("backlog_saas"),
        F.when(backlog, monthly("pos_live_saas_arr")).otherwise(0.0).alias("pre_live_saas"),
        F.when(backlog, 0.0).otherwise(monthly("pos_live_saas_arr")).alias("live_saas"),
        F.when(paying, monthly("annual_gmv")).otherwise(0.0).alias("monthly_gmv"),
        F.when(paying, monthly("payments_margin_arr_full_month")).otherwise(0.0).alias("monthly_payments_margin")))


def month_axis(days: DataFrame, date_col: str, as_of: str) -> list[str]:
    """First days of the months from the first to the last ``date_col``, none
    after ``as_of``; the month of ``as_of`` alone if there is no such day.  One
    row comes to the driver."""
    end = F.lit(as_of).cast("date")
    r = days.filter(month_start(date_col) <= month_start(end)).agg(
        F.min(date_col).cast("date").alias("lo"), F.max(date_col).cast("date").alias("hi")).first()
    lo, hi = (r["lo"], r["hi"]) if r["lo"] else [date.fromisoformat(as_of)] * 2
    return [f"{m // 12:04d}-{m % 12 + 1:02d}-01" for m in range(lo.year * 12 + lo.month - 1, hi.year * 12 + hi.month)]


def investor_wide(long: DataFrame, months: list[str]) -> DataFrame:
    """M12 wide: one row per account, a column ``<yyyy_MM>_<metric>`` per month
    and metric and ``<yyyy_MM>_status``; ``long`` has one row per account and
    month.  The months are given (``month_axis``: a scan of the days alone), so
    the pipeline does not run twice to find pivot values."""
    columns = ("status", *INVESTOR_METRICS)
    at = {int(m[:4]) * 12 + int(m[5:7]) - 1: m[:7].replace("-", "_") for m in months}
    m = F.year("month") * 12 + F.month("month") - 1
    # one shuffle by account; its months are gathered and each column is read from
    # them, so a row's cost does not grow with the number of columns
    rows = long.select("customer_id", m.alias("m"), *columns).filter(F.col("m").isin(*at)).repartition("customer_id")
    one = rows.groupBy("customer_id", "m").agg(*[F.max(x).alias(x) for x in columns])
    held = one.groupBy("customer_id").agg(F.map_from_entries(F.collect_list(F.struct("m", F.struct(*columns)))).alias("held"))
    return held.select("customer_id", *[F.col("held").getItem(k)[x].alias(f"{label}_{x}") for k, label in at.items() for x in columns])


def payroll_long(invoices: DataFrame, id_map: DataFrame, accounts: DataFrame, start: str) -> DataFrame:
    """Recurring payroll invoices x12 by parent, id and month: parent_id, guid,
    month, ec_saas_arr.  Inputs as of ``recurring_parent_month``."""
    inv = (invoices.filter(F.col("recurring") & (month_start("check_date") >= F.lit(start).cast("date")))
           .groupBy("guid", month_start("check_date").alias("month")).agg(F.sum(F.col("total") * 12).alias("ec_saas_arr")))
    owners = id_map.join(accounts, "account_id").select("guid", "parent_id").distinct()
    return inv.join(owners, "guid").select("parent_id", "guid", "month", "ec_saas_arr")


def payroll_wide(flat: DataFrame, months: list[str]) -> DataFrame:
    """M12 payroll set: one row per (parent, id), a column ``<yyyy_MM>_live_ec_saas``
    per month with the monthly amount."""
    labels = [m[:7].replace("-", "_") for m in months]
    return (flat.withColumn("m", F.date_format("month", "yyyy_MM")).filter(F.col("m").isin(*labels))
            .groupBy("parent_id", "guid").pivot("m", labels).agg((F.round(F.sum("ec_saas_arr"), 2) / 12).alias("live_ec_saas"))
            .withColumnsRenamed({m: f"{m}_live_ec_saas" for m in labels}))


ACCOUNT_ATTRIBUTES = ("location_name", "market_segment", "restaurant_type", "state", "first_go_live_on_parent", "parent_name")


def account_timeline(long: DataFrame, accounts: DataFrame, far: str = "2099-01-01",
                     no_go_live: str = "2013-01-02", info: DataFrame | None = None) -> DataFrame:
    """M13, per account of ``long``: latest status, booking and go-live date, and
    the ACCOUNT_ATTRIBUTES of ``info`` (customer_id and these) when given.

    accounts: customer_id, first_order_date, close_date.  First booked month:
    of Backlog or Live rows; first live month: of Live rows.  Go-live is the
    first live month when that precedes the month of the first order, else the
    first order.  Booking is the close date, or the day before go-live when it
    lies behind that (``far`` without one); an earlier first booked month
    replaces it."""
    last = latest_rows(long.select("customer_id", "month", "status"), ["customer_id"], "month").drop("month")
    g = long.groupBy("customer_id").agg(
        F.min(F.when(F.col("status").isin("Backlog", "Live"), F.col("month"))).alias("booked"),
        F.min(F.when(F.col("status") == "Live", F.col("month"))).alias("live"))
    j = g.join(last, "customer_id").join(accounts.select("customer_id", "first_order_date", "close_date"), "customer_id", "left")
    go = F.when(F.col("live") < month_start("first_order_date"), F.col("live")).otherwise(F.col("first_order_date"))
    day = lambda d: F.lit(d).cast("date")
    book = F.coalesce(F.when(F.col("close_date") > F.col("go_live_date"),
                             F.date_sub(F.coalesce("go_live_date", day(no_go_live)), 1)).otherwise(F.col("close_date")), day(far))
    out = j.withColumn("go_live_date", go).select(
        "customer_id", F.col("status").alias("last_status"),
        F.when(F.col("booked") < month_start("close_date"), F.col("booked")).otherwise(book).alias("booking_date"),
        "go_live_date")
    return out if info is None else out.join(info.select("customer_id", *ACCOUNT_ATTRIBUTES), "customer_id", "left")


@dataclass(frozen=True)
class InvestorInputs:
    """What the investor data set is made of; frames as in the functions above."""

    locations: DataFrame
    accounts: DataFrame
    info: DataFrame
    payroll: DataFrame
    months: tuple[str, ...]


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def investor_dataset(inputs: InvestorInputs, folder: str | None = None, save: bool = True, save_raw: bool = False,
                     stage: str | None = None) -> dict[str, DataFrame]:
    """M12/M13 as a whole: account info, monthly location data, monthly payroll data
    and payroll account info, and with ``save_raw`` the two long sets.

    The long location and payroll sets feed three outputs each; they are written
    once to ``stage`` and read from there, so the chains before them run once.  With ``save`` the outputs
    are committed to ``folder`` together (``sources.sinks.Bundle``)."""
    long, payroll = investor_long(inputs.locations), inputs.payroll
    if stage:
        long, payroll = [_staged(df, f"{stage}/{name}") for df, name in ((long, "locations"), (payroll, "payroll"))]
    payroll_accounts = payroll.groupBy("parent_id", "guid").agg(F.min("month").alias("first_month"))
    out = {"account_info": account_timeline(long, inputs.accounts, info=inputs.info),
           "monthly_location_data": investor_wide(long, list(inputs.months)),
           "monthly_payroll_data": payroll_wide(payroll, list(inputs.months)),
           "payroll_account_info": payroll_accounts}
    if save_raw:
        out |= {"investor_long": long, "payroll_long": payroll}
    if save:
        if not folder:
            raise ValueError("a folder is needed to save the data set")
        from ..sources.sinks import Bundle
        Bundle(long.sparkSession, folder).commit(out)
    return out
