"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the fixture bindings) and
runs one pipeline over the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.buckets import ilike_any
from .functions.dates import month_start, prev_quarter_start
from .operators import quantiles, stats
from .operators.aggregates import value_counts
from .operators.joins import hierarchy, natural_merge
from .operators.windows import top_k
from .plans import arpu, attach, care, churn, cohort, series, uplift
from .plans import modules as mods
from .plans import reporting as rep
from .plans import subscription as sub
from .plans import tickets as tk
from .sources import fixtures as fx
from .sources.query import coerce_types, query_to_table
from .sources.shared import new_folder, staged
from .sources.sinks import Bundle, MonthTable
from .sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf_dir) -> Tables:
    """A fresh table accessor per query call (its memo holds lazy frames
    only for the duration of building one query)."""
    return Tables(spark, sf_dir)


# --------------------------------------------------------------- subscription
def _ret_panel(t):
    return sub.with_twelve_month_twin(fx.customer_month(t), ["customer_id"])


@register("m14_net_retention")
def m14_net(spark, d):
    return sub.retention(_ret_panel(_t(spark, d)), "net")


@register("m14_gross_retention")
def m14_gross(spark, d):
    return sub.retention(_ret_panel(_t(spark, d)), "gross")


@register("m15_retention_by_year")
def m15(spark, d):
    return sub.retention_by_year(sub.retention(_ret_panel(_t(spark, d)), "net"), before="2001-01-01")


@register("m16_monthly_qa")
def m16(spark, d):
    return sub.monthly_qa(fx.customer_month(_t(spark, d)), 1998)


@register("m3_month_end_subscription")
def m3(spark, d):
    t = _t(spark, d)
    return sub.month_end_subscription(fx.snapshot(t), fx.customers(t))


@register("m4_monthly_volume")
def m4(spark, d):
    return sub.monthly_volume(fx.daily(_t(spark, d)))


@register("m5_monthly_payments")
def m5(spark, d):
    return sub.monthly_payments(fx.daily(_t(spark, d)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["m14_net_retention"](spark, sf_dir)


# ------------------------------------------------------------ churn / cohort


PROCESSOR_VENDORS = {"urgent": "1-URGENT", "high": "2-HIGH"}
CARE_START, CARE_END = "2024-01-01", "2024-01-31"


@register("m42_processor_churn")
def m42(spark, d):
    t = _t(spark, d)
    o = fx.order_days(t)
    # a pending or open order names no vendor yet: a customer's first months may
    # only be filled from a later one
    ev = o.filter(F.col("o_orderstatus") == "F").select("customer_id", "dt", F.col("o_orderkey").alias("seq"),
                  F.col("o_orderpriority").alias("vendor"))
    pay = o.groupBy("customer_id", month_start("dt").alias("month")).agg(F.sum("o_totalprice").alias("gmv"))
    return churn.processor_churn(fx.customers(t), ev, pay, "1995-01-01", fx.AS_OF, PROCESSOR_VENDORS)


COHORT_RULES = cohort.CohortRules(excluded_resellers=("Reseller 3", "Reseller 11"), excluded_owner_accounts=("N20",),
                                  excluded_sellers=("Seller 1",))


def _flows(t, levels=1):
    """The owners' flows, saved: jobs that need other stocks beside them read these."""
    flows = cohort.account_flows(fx.account_opportunities(t), fx.account_products(t), COHORT_RULES)
    return cohort.owner_flows(flows, fx.account_directory(t), fx.account_snapshots(t), COHORT_RULES, levels, fx.parent_snapshots(t),
                              lambda df: staged(df, "cohort-flows"))


def _cohort(t, levels=1, flows=None, days=None, month=None):
    """``days`` and ``month``: other daily rows, all of one month."""
    snapshots, parents = fx.account_snapshots(t), fx.parent_snapshots(t)
    if month:
        snapshots, parents = [s.filter(F.col("month") == F.lit(month).cast("date")) for s in (snapshots, parents)]
    stocks = cohort.cohort_stocks(fx.account_days(t) if days is None else days, snapshots, fx.account_directory(t), COHORT_RULES, parents)
    g = cohort.with_flows(stocks, *(flows or _flows(t, levels)))
    return g.select("dt", *cohort.OWNER, "location_count", *[F.round(c, 2).alias(c) for c in ["live_saas_arr"] + cohort.FLOWS])


@register("m43_cohort_drivers")
def m43(spark, d):
    return _cohort(_t(spark, d))


@register("m44_period_growth")
def m44(spark, d):
    return cohort.period_growth(_cohort(_t(spark, d)), fx.AS_OF)


RESTATED = "1999-05-01"     # the month whose amounts are restated to their double


def _saved_cohort(spark, d):
    """The cohort table, saved by month; then one month is restated and its
    partition alone rewritten, from that month's days alone."""
    t = _t(spark, d)
    table = MonthTable(spark, new_folder(spark, "cohort-growth"))
    flows = _flows(t)
    table.create(_cohort(t, flows=flows))
    days = fx.account_days(t).filter(F.trunc("dt", "month") == F.lit(RESTATED).cast("date"))
    table.replace(_cohort(t, flows=flows, days=days.withColumn("live_amount", F.col("live_amount") * 2), month=RESTATED), [RESTATED])
    return table


@register("snk3_saved_cohort")
def snk3(spark, d):
    return _saved_cohort(spark, d).read().drop(MonthTable.PART)


@register("snk3_saved_growth")
def snk3g(spark, d):
    """Period growth read from the saved cohort table."""
    return cohort.period_growth(_saved_cohort(spark, d).read().drop(MonthTable.PART), fx.AS_OF)


# --------------------------------------------------------------------- care
# Binding values of the two care reports.
_ROLES = (("%senior tier 1%", "Senior Specialist"), ("%senior tier 2%", "Senior Expert"),
          ("%tier 1%", "Specialist"), ("%tier 2%", "Expert"), ("%sme%", "SME"))
OCCUPANCY_LABELS = care.Labels(
    campaigns={"kitchen": "Kitchen", "hardware": "Hardware", "chat": "Chat", "network": "Networking", "payments": "Money",
               "integrations": "Integrations", "enterprise": "Enterprise", "escalations": "Escalations"},
    outsourced=("vendor a", "vendor b"), roles=_ROLES, ready=("Ready",), handle=("On Call", "After Call Work", "On Hold"),
    other="No Campaign")
ATTRITION_LABELS = care.Labels(
    campaigns={"kitchen": "Kitchen", "hardware": "Hardware", "chat": "Chat", "network": "Networking", "payments": "Money",
               "enterprise": "Enterprise"},
    vendor="vendor b", vendor_campaigns={"integrations": "Integrations"}, outsourced=("vendor a", "vendor b"),
    roles=_ROLES, ready=(), handle=(), excluded=("back office",))


@register("m50_occupancy")
def m50(spark, d):
    t = _t(spark, d)
    return care.occupancy(fx.agent_state_log(t), fx.employee_daily(t), CARE_START, CARE_END, OCCUPANCY_LABELS)


@register("m51_attrition")
def m51(spark, d):
    t = _t(spark, d)
    return care.attrition(fx.employee_daily(t), CARE_START, CARE_END, ATTRITION_LABELS, office="south",
                          office_end="2024-01-30")


@register("m49_unmatched_identities")
def m49(spark, d):
    t = _t(spark, d)
    as_of = F.lit(fx.AS_OF).cast("date")
    lists = (t("customer").select(as_of.alias("as_of"), F.upper("c_name").alias("email"),
                                  F.lit("list_a").alias("source"))
             .unionByName(t("supplier").select(as_of.alias("as_of"), F.col("s_name").alias("email"),
                                               F.lit("list_b").alias("source"))))
    # a user without an address (binding: a negative balance) is reported too
    directory = t("customer").select(F.col("c_name").alias("username"),
                                     F.when(F.col("c_acctbal") >= 0, F.lower("c_name")).alias("email"))
    return care.unmatched_identities(lists, directory, "2001-01-01")


@register("m52_managed_counts")
def m52(spark, d):
    t = _t(spark, d)
    cust = t("customer").select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("segment"),
                                F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("manager_id"))
    cust = cust.join(fx.customers(t).select(F.col("customer_id").alias("account_id"), "first_order_date", "churn_date"),
                     "account_id")
    mgr = t("nation").select(F.col("n_nationkey").alias("manager_id"), F.col("n_name").alias("manager_name"))
    return care.managed_counts(cust, mgr)


# ------------------------------------------------------------ modules/uplift

# Fixed binding values: module columns <- p_type; 'standard' is the core
# product (not counted); guest modules; payments-tx priority; payroll status.
MODULE_TYPES = {"economy": "ECONOMY", "large": "LARGE", "medium": "MEDIUM", "promo": "PROMO",
                "small": "SMALL", "standard": "STANDARD"}
COUNTED = ["economy", "large", "medium", "promo", "small"]
GUEST = ["promo", "small"]
TDS_PRIORITY = "3-MEDIUM"
EC_STATUS = "P"
MODULE_SINCE = "1996-01-01"
MODULE_TERM = 270
PANEL_MODULES = list(MODULE_TYPES) + ["tds", "ec", "mod_count"]
UPLIFT_MODULES = PANEL_MODULES + ["guest_count"]
BUNDLE_FLAGS = {"PR": "promo", "SM": "small", "EC": "ec", "TD": "tds"}
BUNDLE_MIN_N = 20


def _module_quarters(t):
    o = fx.order_days(t)
    ends = fx.customer_ends(t).select("customer_id", F.col("churn_date").alias("end_date"))
    # a purchase sets the module's quantity from its day on; it lapses after the term
    bought = fx.module_lines(t).filter(F.col("o_orderstatus") == "F").groupBy("customer_id", "module", "dt").agg(F.sum("qty").alias("qty"))
    lines = mods.quarter_end_states(bought, ["customer_id", "module"], ["qty"], ends, fx.AS_OF, MODULE_SINCE, MODULE_TERM)
    status = fx.daily(t).select("customer_id", "dt", "status_code")
    live = mods.quarter_end_states(status, ["customer_id"], ["status_code"], ends, fx.AS_OF, MODULE_SINCE)
    live = live.filter(fx.status_label(F.col("status_code")) == "Live")
    tds = o.select("customer_id", "dt", (F.col("o_orderpriority") == TDS_PRIORITY).cast("long").alias("tds_tx"))
    ec = o.filter(F.col("o_orderstatus") == EC_STATUS).select("customer_id", "dt")
    return mods.module_quarters(lines, live, tds, ec, MODULE_TYPES, COUNTED, MODULE_SINCE)


def _mod_panel(t):
    mq = _module_quarters(t).withColumnRenamed("tds_count", "tds").withColumnRenamed("ec_count", "ec")
    mq = mq.select("customer_id", "quarter", *[F.col(f"{m}_count").alias(m) for m in MODULE_TYPES],
                   "tds", "ec", F.col("unique_mod").alias("mod_count"))
    return mq.filter(F.col("mod_count").isNotNull())


@register("m23_module_distribution")
def m23(spark, d):
    return mods.module_distribution(_module_quarters(_t(spark, d)))


@register("m25_customer_quarter_modules")
def m25(spark, d):
    p = _mod_panel(_t(spark, d))
    return p.select("customer_id", "quarter", prev_quarter_start("quarter").alias("prev_quarter"),
                    F.add_months("quarter", 15).alias("next_year"),
                    *[F.round(m, 2).alias(m) if m in MODULE_TYPES else F.col(m) for m in PANEL_MODULES])


def _module_yoy(t):
    return mods.module_yoy(_mod_panel(t), PANEL_MODULES, months=15)


@register("m26_module_yoy")
def m26(spark, d):
    y = _module_yoy(_t(spark, d))
    return y.select("customer_id", "quarter", *[F.round(c, 2).alias(c) if c.split("_ly")[0] in MODULE_TYPES
                                                else F.col(c) for c in y.columns[2:]])


@register("m24_latest_customer")
def m24(spark, d):
    t = _t(spark, d)
    return uplift.latest_customer(fx.daily(t), fx.customers(t), ["segment", "parent_id"])


def _qv(t):
    return uplift.quarter_volume(fx.daily(t), fx.customers(t))


@register("m27_quarter_volume")
def m27(spark, d):
    q = _qv(_t(spark, d))
    return q.select("customer_id", "quarter", F.round("gmv", 2).alias("gmv"), "active_days",
                    *[F.round(c, 4).alias(c) for c in q.columns[4:]])


YEAR_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
SKETCH_SIZE = 1024


@register("agg8_year_quantiles")
def agg8(spark, d):
    """Yearly quartiles of daily volumes from saved (customer, quarter) sketches,
    held against the days: a quartile is right when its rank is within twice the
    sketch's stated error of what was asked."""
    t = _t(spark, d)
    path = new_folder(spark, "volume-sketches")
    uplift.quarter_sketches(fx.daily(t), fx.customers(t), SKETCH_SIZE).write.parquet(path)
    saved = spark.read.parquet(path).withColumn("year", F.year("quarter"))
    years = quantiles.merged_quantiles(saved, ["year"], YEAR_PROBS, SKETCH_SIZE)
    days = uplift.counted_days(fx.daily(t), fx.customers(t)).filter(F.col("volume") > 0).select(F.year("dt").alias("year"), "volume")
    both = days.join(F.broadcast(years), "year")        # a row per year
    below = [F.count_if(F.col("volume") < F.col(c)).alias(f"lt_{c}") for c in YEAR_PROBS]
    upto = [F.count_if(F.col("volume") <= F.col(c)).alias(f"le_{c}") for c in YEAR_PROBS]
    g = both.groupBy("year", "n").agg(F.count("*").alias("days"), *below, *upto)
    e = 2 * quantiles.rank_error(SKETCH_SIZE)
    ok = [((F.col(f"lt_{c}") / F.col("days") <= p + e) & (F.col(f"le_{c}") / F.col("days") >= p - e)).alias(f"{c}_ok") for c, p in YEAR_PROBS.items()]
    return g.select("year", "n", "days", *ok)


def _vy(t):
    return uplift.volume_yoy(_qv(t), 12)


@register("m28_volume_yoy")
def m28(spark, d):
    v = _vy(_t(spark, d))
    types = dict(v.dtypes)
    return v.select("customer_id", "quarter", *[
        F.round(c, 4).alias(c) if types[c] == "double" and not c.endswith("_pct") else F.col(c)
        for c in v.columns[2:]])


def _panel(t):
    return uplift.growth_panel(_vy(t), _module_yoy(t), PANEL_MODULES, GUEST)


@register("m29_growth_panel")
def m29(spark, d):
    p = _panel(_t(spark, d))
    return p.select("customer_id", "quarter", "gmv_pd_growth_pct", "guest_count", "guest_count_ly",
                    *[F.round(f"{m}_change", 2).alias(f"{m}_change") for m in UPLIFT_MODULES])


@register("m30_adopter_uplift")
def m30(spark, d):
    return uplift.adopter_uplift(_panel(_t(spark, d)), UPLIFT_MODULES, with_p=False)


@register("m30_adopter_uplift_pvalue")
def m30p(spark, d):
    return uplift.adopter_uplift(_panel(_t(spark, d)), UPLIFT_MODULES, with_p=True)


@register("m31_bundle_uplift")
def m31(spark, d):
    return uplift.bundle_uplift(_panel(_t(spark, d)), BUNDLE_FLAGS, None,
                                min_n=BUNDLE_MIN_N, with_p=False)


@register("m32_single_module_uplift")
def m32(spark, d):
    return uplift.bundle_uplift(_panel(_t(spark, d)), {"PR": "promo"}, None, min_n=0, with_p=False)


@register("m31_bundle_uplift_pvalue")
def m31p(spark, d):
    return uplift.bundle_uplift(_panel(_t(spark, d)), BUNDLE_FLAGS, None, min_n=BUNDLE_MIN_N, with_p=True)


@register("m32_single_module_uplift_pvalue")
def m32p(spark, d):
    return uplift.bundle_uplift(_panel(_t(spark, d)), {"PR": "promo"}, None, min_n=0, with_p=True)


# ------------------------------------------------------- location-month chain
# Fixture schedule: the contract's rates with change dates moved into the
# fixture's years and tier edges scaled to its account counts.
FIXTURE_SCHEDULE = sub.ShareSchedule(first_change="1998-03-01", tds_edges=(20, 50, 100, 200),
                                     second_change="1998-10-01", gh_edges=(20, 40))
EC_START = "1996-07-01"
ARPU_SEGMENT, ARPU_SINCE = "BUILDING", "1996-01-01"
SURVEYS_AS_OF = "2024-07-20"     # the surveys (events) are of January 2024
NON_RECURRING_PRIORITY = "5-LOW"


@register("m1_explode_ids")
def m1(spark, d):
    return sub.explode_ids(fx.id_lists(_t(spark, d)), "id_list", "account_id")


def _invoices(t):
    return fx.order_days(t).select(F.concat(F.lit("G-"), F.col("customer_id").cast("string")).alias("guid"),
                                   F.col("dt").alias("check_date"), F.col("o_totalprice").alias("total"),
                                   (F.col("o_orderpriority") != NON_RECURRING_PRIORITY).alias("recurring"))


def _ec_parent(t, allow_fanout=False):
    ids = sub.explode_ids(fx.id_lists(t), "id_list", "account_id")
    inv = _invoices(t)
    acc = t("customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("parent_id"))
    return sub.recurring_parent_month(inv, ids, acc, EC_START, allow_fanout=allow_fanout)


@register("joi21_billed_ids")
def joi21(spark, d):
    """Listed ids that have at least one invoice (semi-join: no invoice row
    multiplies an id)."""
    t = _t(spark, d)
    billed = fx.order_days(t).select(F.concat(F.lit("G-"), F.col("customer_id").cast("string")).alias("guid"))
    return sub.explode_ids(fx.id_lists(t), "id_list", "account_id").join(billed, "guid", "left_semi").select(
        "guid", "account_id")


@register("joi3_reseller_terms")
def joi3(spark, d):
    """Accounts with the terms of their reseller.  Most accounts have none, and the
    terms of direct sales stand under the null reseller: null keys on both sides."""
    accounts = fx.account_directory(_t(spark, d)).select("account_id", "reseller", "churn_reason")
    terms = accounts.groupBy("reseller").agg(F.count("*").alias("accounts"), F.count("churn_reason").alias("churned"))
    return natural_merge(accounts.select("account_id", "reseller"), terms)


@register("m2_recurring_parent_month_fanout")
def m2f(spark, d):
    """Every listed id of a parent counts its invoices, as an unguarded join does."""
    return _ec_parent(_t(spark, d), allow_fanout=True)


@register("m2_recurring_parent_month")
def m2(spark, d):
    return _ec_parent(_t(spark, d))


def _live_month(t):
    return (fx.daily(t).filter(F.col("status") == "Live")
            .groupBy("customer_id", month_start("dt").alias("month"))
            .agg((F.sum("margin") * 12).alias("payments_margin_arr"),
                 *[F.sum(c).alias(c) for c in fx.SOURCE_PRIORITY]))


@register("m6_revenue_share")
def m6(spark, d):
    return sub.revenue_share(_live_month(_t(spark, d)), FIXTURE_SCHEDULE)


def _loc(t, persist=False):
    """Location-month table (M7).  When one query reads it twice with
    different column sets (proration + parent roll-up), exchange reuse cannot
    share the work, so that caller persists it (memory, spilling to disk;
    lost blocks are recomputed from lineage).  Single readers stream it."""
    key = ("loc", persist)
    if key not in t.memo:
        loc = sub.location_month(sub.month_facts(fx.daily(t), fx.status_label), fx.customers(t), FIXTURE_SCHEDULE)
        t.memo[key] = loc.persist(StorageLevel.MEMORY_AND_DISK) if persist else loc
    return t.memo[key]


_M7_OUT = ["customer_id", "parent_id", "month", "month_12", "status", "status_12", "is_live_12",
           "churn_reason", "live_count", "backlog_count", "go_live_count", "booked_count",
           "pos_live_saas_arr", "pos_live_saas_arr_full_month", "payments_margin_arr_full_month",
           "annual_gmv", "annual_gpv", "has_guest_saas"]


def _round_money(df, cols):
    types = dict(df.dtypes)   # one schema lookup
    return df.select(*[F.round(c, 2).alias(c) if types[c] == "double" else F.col(c) for c in cols])


@register("m7_location_month")
def m7(spark, d):
    return _round_money(_loc(_t(spark, d)), _M7_OUT)


@register("m8_churn_policy_remove")
def m8(spark, d):
    return _round_money(sub.apply_churn_policy(_loc(_t(spark, d)), "remove"), _M7_OUT)


def _parent_month(t, policy="keep"):
    return sub.parent_month(sub.apply_churn_policy(_loc(t), policy), _ec_parent(t), fx.parents(t))


@register("m9_parent_month")
def m9(spark, d):
    p = _parent_month(_t(spark, d))
    return _round_money(p, p.columns)


@register("m14_parent_net_retention")
def m14p(spark, d):
    """Net retention on the parent-month panel (the full M7-M9 chain)."""
    p = _parent_month(_t(spark, d)).select(
        "month", F.col("pos_live_saas_arr_full_month").alias("pos_saas_arr"),
        F.col("pos_live_saas_arr_full_month_12").alias("pos_saas_arr_12"),
        "ec_saas_arr", "ec_saas_arr_12",
        F.col("payments_margin_arr_full_month").alias("payments_arr"),
        F.col("payments_margin_arr_full_month_12").alias("payments_arr_12"),
        "annual_gmv", "annual_gmv_12", "annual_gpv", "annual_gpv_12")
    return sub.retention(p, "net")


def _prorated(t):
    cust = fx.customers(t)
    par = fx.parents(t).select("parent_id", "parent_first_go_live")
    acc = cust.select("customer_id", "parent_id", F.col("segment").alias("market_segment")).join(
        par, "parent_id", "left")
    keep = sub.apply_churn_policy(_loc(t, persist=True), "keep")
    pm = sub.parent_month(keep, _ec_parent(t), fx.parents(t))
    return sub.location_month_prorated(keep.drop("parent_id"), pm, acc)


@register("m10_location_month_prorated")
def m10(spark, d):
    p = _prorated(_t(spark, d))
    # the prorated EC ARR is a cent amount divided by a location count: the
    # same double on any engine, so it is returned as computed (rounding it
    # again could land on a ...5 tie)
    return p.select("customer_id", "parent_id", "month", "live_count", "live_count_12", "live_locations",
                    "live_locations_12", "ec_saas_arr", "ec_saas_arr_12",
                    F.round("pos_live_saas_arr_full_month", 2).alias("pos_live_saas_arr_full_month"),
                    F.round("pos_live_saas_arr_full_month_12", 2).alias("pos_live_saas_arr_full_month_12"),
                    "quarter")


@register("m11_arpu_by_line")
def m11(spark, d):
    t = _t(spark, d)
    return sub.arpu_by_line(_prorated(t), fx.nps_scores(t), ARPU_SEGMENT, ARPU_SINCE, SURVEYS_AS_OF)


@register("m12_investor_long")
def m12l(spark, d):
    return sub.investor_long(_loc(_t(spark, d)))


@register("m12_investor_wide")
def m12w(spark, d):
    t = _t(spark, d)
    months = sub.month_axis(fx.order_days(t), "dt", fx.AS_OF)
    return sub.investor_wide(sub.investor_long(_loc(t)), months)


@register("m13_account_timeline")
def m13(spark, d):
    t = _t(spark, d)
    return sub.account_timeline(sub.investor_long(_loc(t)), fx.accounts(t), info=fx.account_info(t))


def _payroll(t):
    ids = sub.explode_ids(fx.id_lists(t), "id_list", "account_id")
    acc = t("customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("parent_id"))
    return sub.payroll_long(_invoices(t), ids, acc, EC_START)


@register("m12_payroll_wide")
def m12p(spark, d):
    t = _t(spark, d)
    return sub.payroll_wide(_payroll(t), sub.month_axis(fx.order_days(t), "dt", fx.AS_OF))


@register("snk5_investor_bundle")
def snk5(spark, d):
    """The investor data set saved as one bundle; the outputs and row counts that
    its manifest names, and the accounts of each output as read back."""
    t = _t(spark, d)
    inputs = sub.InvestorInputs(_loc(t), fx.accounts(t), fx.account_info(t), _payroll(t),
                                tuple(sub.month_axis(fx.order_days(t), "dt", fx.AS_OF)))
    folder = new_folder(spark, "investor")
    sub.investor_dataset(inputs, folder, save_raw=True, stage=new_folder(spark, "investor-long"))
    bundle = Bundle(spark, folder)
    out = None
    for name, n in sorted(bundle.manifest()["rows"].items()):
        df = bundle.read(name)
        key = "customer_id" if "customer_id" in df.columns else "guid"
        one = df.agg(F.lit(name).alias("output"), F.lit(n).cast("long").alias("rows"), F.count("*").alias("rows_read"),
                     F.count_distinct(key).alias("accounts"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ reporting

KEY_MEASURES = {"live_payments_arr": "payments_arr", "live_saas_arr": "pos_saas_arr",
                "live_ec_arr": "ec_saas_arr", "live_arr": "live_arr"}


@register("m17_arr_report")
def m17(spark, d):
    cm = fx.customer_month(_t(spark, d)).withColumn(
        "live_arr", F.col("payments_arr") + F.col("pos_saas_arr") + F.col("ec_saas_arr"))
    return rep.arr_report(rep.key_metrics(cm, KEY_MEASURES), "FULL MONTH")


@register("m17_arr_report_quarter")
def m17q(spark, d):
    cm = fx.customer_month(_t(spark, d)).withColumn(
        "live_arr", F.col("payments_arr") + F.col("pos_saas_arr") + F.col("ec_saas_arr"))
    return rep.arr_report(rep.key_metrics(cm, KEY_MEASURES), "QUARTER")


@register("m18_annualized_volume")
def m18(spark, d):
    li = _t(spark, d)("lineitem").select(F.to_date("l_shipdate").alias("dt"),
                                         F.col("l_extendedprice").alias("volume"), F.lit(1).alias("tx"))
    return rep.annualized_volume(li)


def _m19(t):
    return rep.churn_counts(fx.customer_months(t))


def _m20(t):
    o = fx.order_days(t).join(t("customer").select(F.col("c_custkey").alias("customer_id"),
                                                   F.col("c_nationkey").alias("parent_id")), "customer_id")
    return rep.new_parents(o.select("parent_id", F.col("dt").alias("close_date"),
                                    (F.col("o_orderstatus") == "F").alias("is_won")))


def _m21(t):
    cust = fx.customers(t)
    m3 = sub.month_end_subscription(fx.snapshot(t), cust)
    return rep.month_end_parents(m3.join(cust.select("customer_id", "parent_id"), "customer_id"))


@register("m19_churn_counts")
def m19(spark, d):
    return _m19(_t(spark, d))


@register("m20_new_parents")
def m20(spark, d):
    return _m20(_t(spark, d))


@register("m21_month_end_parents")
def m21(spark, d):
    return _m21(_t(spark, d))


@register("m22_customer_report")
def m22(spark, d):
    t = _t(spark, d)
    return rep.customer_report(_m19(t), _m20(t), _m21(t))


# ------------------------------------------------------------------- ARPU
ARPU_QUARTERS = ("1996-01-01", "2001-07-01")
CURRENT_MONTH = "2000-06-01"
HEADROOM_MIN_N = 3
LIVE_MONTH_MIN_N = 10
MIX_TYPE, MIX_TIER = "FSR - BUILDING", "1M - 3M"
MORE_ARR_COLS = ("guest_saas_arr", "commerce_saas_arr", "xc_saas_arr")
ARR_COLS = {"live_payments_arr": "live_payments_arr", "live_saas_arr": "live_saas_arr",
            "ec_saas_arr": "ec_saas_arr"}


def _m33(t):
    return arpu.trailing_volume(fx.monthly_book(t), 12)


@register("m33_trailing_volume")
def m33(spark, d):
    m = _m33(_t(spark, d))
    return m.select("customer_id", "month", "service_group", "close_month", "close_quarter", "foq",
                    F.round("gpv", 2).alias("gpv"), "gpv_last_n_months", "last_months", "annualized_gpv",
                    F.round("live_arr", 2).alias("live_arr"))


@register("m34_split_usage")
def m34(spark, d):
    t = _t(spark, d)
    fixed = (fx.module_lines(t).filter(F.col("module") == "STANDARD")
             .groupBy("customer_id", month_start("dt").alias("month"))
             .agg((F.sum("amount") * 12).alias("ec_monthly_arr")))
    s = arpu.split_usage(_m33(t), fixed)
    return s.select("customer_id", "month", *[F.round(c, 2).alias(c) for c in
                                               ("ec_saas_arr", "ec_monthly_arr", "ec_usage_arr")])


@register("m35_booking_cohort")
def m35(spark, d):
    cols = ["live_arr", *ARR_COLS, *MORE_ARR_COLS]
    b = arpu.booking_cohort(_m33(_t(spark, d)), "service_group", cols, 3, *ARPU_QUARTERS)
    return b.select("close_quarter", "service_group", "locations", F.round("annualized_gpv", 2).alias("annualized_gpv"),
                    "avg_gpv", *[F.round(c, 2).alias(c) for c in cols],
                    *[F.round(f"{c}_arpu", 4).alias(f"{c}_arpu") for c in cols], "percent_of_locations")


@register("m36_live_month_averages")
def m36(spark, d):
    g = arpu.live_month_averages(_m33(_t(spark, d)), "service_group", ARR_COLS, 3, LIVE_MONTH_MIN_N,
                                 *ARPU_QUARTERS)
    return g.select("month", "service_group", "locations",
                    *[F.round(c, 2).alias(c) for c in ARR_COLS],
                    *[F.round(f"{c}_arpu", 4).alias(f"{c}_arpu") for c in ARR_COLS], "percent_of_locations")


def _m37(t):
    m = _m33(t).withColumn("margin_bps", F.try_divide(F.col("margin"), F.col("gpv")) * 10000)
    m = arpu.with_tiers(m, "annualized_gpv", arpu.GPV_EDGES, arpu.GPV_LABELS, "gpv_tier")
    return arpu.with_tiers(m, "margin_bps", arpu.BPS_EDGES, arpu.BPS_LABELS, "bps_tier")


@register("m37_tiers")
def m37(spark, d):
    m = _m37(_t(spark, d))
    return m.select("customer_id", "month", "annualized_gpv", "gpv_tier", "gpv_tier_rank", F.round("margin_bps", 4).alias("margin_bps"), "bps_tier",
                    "bps_tier_rank")


def _current(t):
    return _m37(t).filter(F.col("month") == F.lit(CURRENT_MONTH).cast("date"))


@register("m38_arpu_headroom")
def m38(spark, d):
    h = arpu.arpu_headroom(_current(_t(spark, d)), "full_type", "gpv_tier", "live_arr", 0.95, 0.25,
                           HEADROOM_MIN_N)
    return h.select("full_type", "gpv_tier", "tier_rank", "num_locations", "num_rest",
                    F.round("median_rest", 4).alias("median_rest"), "target",
                    F.round("potential_arr", 4).alias("potential_arr"),
                    F.round("potential_arpu_impact", 6).alias("potential_arpu_impact"))


@register("m39_top_rest_mix")
def m39(spark, d):
    cur = _current(_t(spark, d)).filter((F.col("full_type") == MIX_TYPE) & (F.col("gpv_tier") == MIX_TIER))
    return arpu.top_rest_mix(cur, "live_arr", "bps_tier", arpu.BPS_LABELS, 0.95)


# ------------------------------------------------------------------ attach

# Fixed binding values: won = not 'P'; new business = priorities 1-3;
# module families by part type; acquisition dates of the two families.
FAMILIES = {"guest": ["PROMO", "SMALL"], "core": ["ECONOMY", "LARGE", "MEDIUM"]}
ACQUIRED = {"guest": "1998-06-10", "core": "1997-07-01"}
NEW_BUSINESS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
OPP_SINCE = "1996-07-01"


def _opp_flags(t):
    o = fx.order_days(t).filter(F.col("dt") >= F.lit(OPP_SINCE).cast("date")).select(
        F.col("o_orderkey").alias("opp_id"),
        F.when(F.col("o_orderpriority").isin(*NEW_BUSINESS), "New Business").otherwise("Existing Business")
        .alias("opp_type"), F.col("dt").alias("close_date"), (F.col("o_orderstatus") != "P").alias("is_won"))
    items = (t("lineitem").select("l_orderkey", "l_partkey")
             .join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("l_orderkey").alias("opp_id"), F.col("p_type").alias("product")))
    return attach.opportunity_flags(o, items, FAMILIES)


@register("m40_attach_by_age")
def m40(spark, d):
    return attach.attach_by_age(_opp_flags(_t(spark, d)), ACQUIRED, fx.AS_OF)


@register("m41_attach_by_month")
def m41(spark, d):
    return attach.attach_by_month(_opp_flags(_t(spark, d)), list(FAMILIES), fx.AS_OF)


# ------------------------------------------------------------------ tickets
TICKET_AT, TICKET_END = "1999-01-01", "1999-07-01"
EVENT_START, EVENT_MID, EVENT_END = "2024-01-01", "2024-01-16", "2024-01-31"
TICKET_PATTERNS = ["econ%", "large", "Med%", "promo", "%mall", "standard"]
TICKET_MODULES = ["economy", "large", "medium", "promo", "small", "standard"]
THIRD_PARTY = ["promo", "small"]


def _features(t, with_devices=True):
    cust = fx.customers(t)
    pop = tk.population(cust, TICKET_AT)
    lines = fx.module_lines(t).filter(ilike_any("module", TICKET_PATTERNS)).withColumn("module", F.lower("module"))
    # one pass over the line items of both windows (start modules and the
    # module flags of the period come from the same aggregation)
    state = tk.module_state(lines, TICKET_AT, TICKET_END, TICKET_MODULES)
    dev = fx.devices(t, EVENT_START, EVENT_MID, EVENT_END) if with_devices else None
    return tk.ticket_features(pop, fx.tickets(t, EVENT_START, EVENT_END), state, None,
                              TICKET_MODULES, dev, THIRD_PARTY, 0)


_FEAT_DEV = ["customer_id", "age_bucket", "age", "ticket_count", "start_mods", "start_devices",
             "end_devices", "net_device", *TICKET_MODULES, "end_mods", "modules_added", "third_party",
             "end_mod_sq", "end_devices_sq", "age_sq"]
_FEAT = [c for c in _FEAT_DEV if "device" not in c]


@register("m45_ticket_features")
def m45(spark, d):
    return _features(_t(spark, d)).select(*_FEAT_DEV)


@register("m48_ticket_features_no_devices")
def m48(spark, d):
    return _features(_t(spark, d), with_devices=False).select(*_FEAT)


OLS_X_ALL = ["age", "age_sq", "end_mods", "modules_added", "end_mod_sq", "end_devices", "end_devices_sq",
             "net_device", *TICKET_MODULES, "third_party"]
OLS_X_SEG = [c for c in OLS_X_ALL if not c.startswith("age")]


@register("m46_ols")
def m46(spark, d):
    return stats.ols_segments(_features(_t(spark, d)), "ticket_count", OLS_X_ALL, "age_bucket", OLS_X_SEG)


# without end_mods, the sum of the module columns, the design has full rank
OLS_X_FULL = [c for c in OLS_X_ALL if c != "end_mods"]


@register("m46_ols_full_rank")
def m46f(spark, d):
    """Fits whose coefficients are determined (the segments are large enough
    for that: customers of less than 40 months, and the others)."""
    xs = [c for c in OLS_X_FULL if not c.startswith("age")]
    young = F.when(F.col("age") < 40, "Less than 40 Months").otherwise("40+ Months")
    f = stats.ols_segments(_features(_t(spark, d)).withColumn("tenure", young), "ticket_count", OLS_X_FULL, "tenure", xs)
    return f.select("segment", "term", *[F.round(c, 9).alias(c) for c in ("coef", "std_err", "r2")], "n", "rank")


@register("m46_ols_single")
def m46s(spark, d):
    f = _features(_t(spark, d))
    out = stats.ols_by(f, "ticket_count", ["end_mods"]).unionByName(
        stats.ols_by(f, "ticket_count", ["end_mods"], by="age_bucket"))
    return out.select("segment", "term", F.round("coef", 6).alias("coef"), "n")


_DESCRIBE_COLS = ["age", "ticket_count", "start_mods", "end_mods", "modules_added", "start_devices",
                  "end_devices", "net_device"]


@register("m47_describe")
def m47d(spark, d):
    return stats.describe(_features(_t(spark, d)), _DESCRIBE_COLS)


@register("m47_corr_matrix")
def m47c(spark, d):
    return stats.corr_matrix(_features(_t(spark, d)), _DESCRIBE_COLS)


@register("flt15_ticket_iqr_flags")
def flt15(spark, d):
    f = stats.iqr_flags(_features(_t(spark, d)), "ticket_count", 1.5)
    return f.select("customer_id", "ticket_count", "q1", "q3", "is_upper_outlier", "is_lower_outlier")


@register("agg17_bucket_shares")
def agg17(spark, d):
    """How the accounts of the feature table spread over their module counts."""
    return value_counts(_features(_t(spark, d)), "end_mods")


# ------------------------------------------------------------------ series
def _series(t):
    """Monthly volume per nation, priority and status: all orders, in series
    with gaps."""
    o = fx.order_days(t)
    o = o.join(t("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation")),
               "customer_id")
    name = F.concat_ws("/", "nation", "o_orderpriority", "o_orderstatus")
    return o.groupBy(name.alias("series"), month_start("dt").alias("month")).agg(F.sum("o_totalprice").alias("volume"))


@register("m53_align_series")
def m53(spark, d):
    a = series.align_series(_series(_t(spark, d)), "month", "volume", "series")
    return a.select("series", "month", "pos", F.round("volume", 2).alias("volume"))


def _resampled(t, degree, digits):
    a = series.align_series(_series(t), "month", "volume", "series")
    r = series.resample_curve(a, "series", "pos", "volume", 20, degree=degree)
    return r.select("series", F.round("x", 6).alias("x"), F.round("y", digits).alias("y"))


@register("m54_resample_curve")
def m54(spark, d):
    return _resampled(_t(spark, d), 3, 2)


@register("m54_resample_linear")
def m54l(spark, d):
    return _resampled(_t(spark, d), 1, 4)     # twentieths of cents have four digits


# ------------------------------------------------------------------ sources
@register("src2_coerce_types")
def src2(spark, d):
    """Orders re-read as text, then typed back by the coercion rule."""
    o = _t(spark, d)("orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.col("o_orderpriority"))
    return coerce_types(o)


# --------------------------------------------- SQL path, hierarchy, top-k

CHURN_SQL = """
SELECT month,
       count(DISTINCT CASE WHEN trunc(churn_date, 'MM') = month AND first_order_date IS NOT NULL
                           THEN customer_id END),
       count(DISTINCT CASE WHEN trunc(churn_date, 'MM') = month AND first_order_date IS NULL
                           THEN customer_id END)
FROM {view}
GROUP BY month
"""


@register("src1_sql_churn_counts")
def src1(spark, d):
    """M19 through the SQL path: a temp view over the derived monthly
    snapshot, SQL text, positional column names."""
    view = f"customer_months_{uuid.uuid4().hex[:12]}"        # calls do not share a name
    fx.customer_months(_t(spark, d)).createOrReplaceTempView(view)
    try:        # the view is part of the analysed plan from here on
        return query_to_table(spark, CHURN_SQL.format(view=view), ["month", "churns", "cancelled_contracts"])
    finally:
        spark.catalog.dropTempView(view)


@register("joi10_hierarchy")
def joi10(spark, d):
    t = _t(spark, d)
    ent = (t("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("k"),
                                F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent"))
           .unionByName(t("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("k"),
                                           F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent")))
           .unionByName(t("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("k"),
                                           F.lit(None).cast("string").alias("parent"))))
    return hierarchy(ent, "k", "parent", levels=2).select("k", "parent_1", "parent_2")


@register("srt2_headroom_top5")
def srt2(spark, d):
    """Top 5 type x tier slices by potential ARPU impact (ties broken by
    type and tier)."""
    h = m38(spark, d)
    return top_k(h, [F.col("potential_arpu_impact").desc_nulls_last(), "full_type", "gpv_tier"], 5)


@register("m43_cohort_drivers_grandparent")
def m43g(spark, d):
    """Cohort drivers with the flows rolled up two levels, as the locations are."""
    return _cohort(_t(spark, d), levels=2)
