"""Bindings from the driver's TPC-H-like tables to the input roles the
metric pipelines expect.

Fixed binding rules (they define the test inputs, so they are kept here as
plain values):

* customer -> account/location; ``c_nationkey`` -> parent; ``n_regionkey`` ->
  grandparent; ``c_mktsegment`` -> segment.
* daily snapshot: orders grouped by (customer, order day).  Status of the
  day from the smallest ``o_orderstatus``: F -> Live, O -> Backlog,
  P -> Go-Live.  volume = sum(o_totalprice); tx = count(orders);
  margin = sum(o_totalprice) of priority 1-URGENT orders;
  gpv = sum(o_totalprice) of orders whose priority is not 5-LOW;
  transactions by source tds/dd/gh/ue = order counts of priorities
  1-URGENT / 2-HIGH / 3-MEDIUM / 4-NOT SPECIFIED.
* churn reason: 'Competitor' for churned BUILDING customers, else 'Other'.
* first/last order day per customer from orders; churn date = last order day
  + 180 days when that is on or before ``as_of``, else null.
* modules: ``p_type`` of the parts on an order's line items; quantity =
  sum(l_quantity); activity date = order day.
* agent state intervals: events; agent = user_id, start = ts,
  state = event_type, seconds = int(value * 30).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from functools import wraps

from ..functions.dates import month_start
from .tables import Tables


MEMO_FIXTURES = True


def _memo(fn):
    """Build each fixture frame once per Tables object (frames are lazy:
    this caches plan objects, not data)."""
    @wraps(fn)
    def inner(t: Tables, *args, **kw):
        if not MEMO_FIXTURES:
            return fn(t, *args, **kw)
        key = (fn.__name__, args, tuple(sorted(kw.items())))
        if key not in t.memo:
            t.memo[key] = fn(t, *args, **kw)
        return t.memo[key]
    return inner

AS_OF = "2001-08-01"
STATUS_MAP = {"F": "Live", "O": "Backlog", "P": "Go-Live"}
CHURN_LAG_DAYS = 180
MARGIN_PRIORITY = "1-URGENT"
NON_GPV_PRIORITY = "5-LOW"
MODULES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
STATE_SECONDS_PER_VALUE = 30
SOURCE_PRIORITY = {"tds_tx": "1-URGENT", "dd_tx": "2-HIGH", "gh_tx": "3-MEDIUM", "ue_tx": "4-NOT SPECIFIED"}
COMPETITOR_SEGMENT = "BUILDING"
FSR_SEGMENTS = ("AUTOMOBILE", "BUILDING")
ECOMM_EVERY = 10
CLOSE_LEAD_DAYS = 30


STATUS_CODES = {k: i + 1 for i, k in enumerate(sorted(STATUS_MAP))}   # F < O < P, as the letters


def _status_code(c):
    out = None
    for k, v in STATUS_CODES.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def status_label(code):
    """Status label of a status code (see STATUS_CODES)."""
    labels = [STATUS_MAP[k] for k in sorted(STATUS_CODES, key=STATUS_CODES.get)]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), code)


@_memo
def order_days(t: Tables) -> DataFrame:
    """One row per order with its calendar day (pruned to used columns)."""
    return t("orders").select(
        F.col("o_orderkey"), F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("dt"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@_memo
def daily(t: Tables) -> DataFrame:
    """Daily customer snapshot: customer_id, dt, status_code, status, volume,
    tx, margin, gpv, tx per source."""
    o = order_days(t)
    # the smallest status letter of the day, aggregated as an integer code so
    # the aggregation stays hash-based (a string buffer forces a sort)
    return (o.groupBy("customer_id", "dt").agg(
        F.min(_status_code(F.col("o_orderstatus"))).alias("status_code"),
        F.sum("o_totalprice").alias("volume"),
        F.count(F.lit(1)).alias("tx"),
        F.coalesce(F.sum(F.when(F.col("o_orderpriority") == MARGIN_PRIORITY, F.col("o_totalprice"))),
                   F.lit(0.0)).alias("margin"),
        F.coalesce(F.sum(F.when(F.col("o_orderpriority") != NON_GPV_PRIORITY, F.col("o_totalprice"))),
                   F.lit(0.0)).alias("gpv"),
        *[F.count_if(F.col("o_orderpriority") == v).alias(k) for k, v in SOURCE_PRIORITY.items()])
        .withColumn("status", status_label(F.col("status_code"))))


@_memo
def order_span(t: Tables) -> DataFrame:
    o = order_days(t)
    return o.groupBy("customer_id").agg(F.min("dt").alias("first_order_date"),
                                         F.max("dt").alias("last_order_date"))


@_memo
def customer_ends(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """customer_id, first_order_date, last_order_date, churn_date of customers
    with an order."""
    churn = F.date_add("last_order_date", CHURN_LAG_DAYS)
    return order_span(t).withColumn("churn_date", F.when(churn <= F.lit(as_of).cast("date"), churn))


@_memo
def customers(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """customer_id, customer_name, parent_id, grandparent_id, segment, acctbal,
    first_order_date, last_order_date, churn_date."""
    nation = t("nation").select(F.col("n_nationkey"), F.col("n_regionkey").alias("grandparent_id"))
    churn = F.date_add("last_order_date", CHURN_LAG_DAYS)
    return (t("customer").select(F.col("c_custkey").alias("customer_id"),
                                 F.col("c_name").alias("customer_name"),
                                 F.col("c_nationkey").alias("parent_id"),
                                 F.col("c_mktsegment").alias("segment"),
                                 F.col("c_acctbal").alias("acctbal"))
            # nation is a fixed 25-row dimension: broadcasting it is size-safe
            .join(F.broadcast(nation), F.col("parent_id") == F.col("n_nationkey"), "inner")
            .drop("n_nationkey")
            .join(order_span(t), "customer_id", "left")
            .withColumn("churn_date", F.when(churn <= F.lit(as_of).cast("date"), churn))
            .withColumn("churn_reason", F.when(F.col("churn_date").isNotNull(),
                                               F.when(F.col("segment") == COMPETITOR_SEGMENT, "Competitor")
                                               .otherwise("Other"))))


@_memo
def accounts(t: Tables) -> DataFrame:
    """customer_id, first_order_date, close_date (within 40 days of the first
    order, on either side, by customer_id; every 11th account has none)."""
    lag = (F.col("customer_id") % 80 - 40).cast("int")
    return customers(t).select("customer_id", "first_order_date", F.when(
        F.col("customer_id") % 11 != 0, F.date_add("first_order_date", lag)).alias("close_date"))


@_memo
def account_info(t: Tables) -> DataFrame:
    """customer_id, location_name, market_segment, restaurant_type (FSR or QSR),
    state (nation name), first_go_live_on_parent, parent_name."""
    p = parents(t).select("parent_id", "parent_name", F.col("parent_first_go_live").alias("first_go_live_on_parent"))
    return customers(t).join(F.broadcast(p), "parent_id", "left").select(      # a row per nation
        "customer_id", F.col("customer_name").alias("location_name"), F.col("segment").alias("market_segment"),
        F.when(F.col("segment").isin(*FSR_SEGMENTS), "FSR").otherwise("QSR").alias("restaurant_type"),
        F.col("parent_name").alias("state"), "first_go_live_on_parent", "parent_name")


@_memo
def customer_month(t: Tables) -> DataFrame:
    """Customer-month measures (annualised x12): pos_saas_arr (Live days),
    ec_saas_arr (Go-Live days), payments_arr (margin), annual_gmv, annual_gpv,
    plus volume, tx, live_days and gh_tx."""
    d = daily(t)
    live = F.col("status") == "Live"
    return (d.groupBy("customer_id", month_start("dt").alias("month")).agg(
        (F.coalesce(F.sum(F.when(live, F.col("volume"))), F.lit(0.0)) * 12).alias("pos_saas_arr"),
        (F.coalesce(F.sum(F.when(F.col("status") == "Go-Live", F.col("volume"))), F.lit(0.0)) * 12)
        .alias("ec_saas_arr"),
        (F.sum("margin") * 12).alias("payments_arr"),
        (F.sum("volume") * 12).alias("annual_gmv"),
        (F.sum("gpv") * 12).alias("annual_gpv"),
        F.sum("volume").alias("volume"),
        F.sum("tx").alias("tx"),
        F.count_if(live).alias("live_days"),
        F.sum("gh_tx").alias("gh_tx"),
        F.sum("margin").alias("margin")))


@_memo
def module_lines(t: Tables) -> DataFrame:
    """customer_id, dt, o_orderkey, o_orderstatus, module, qty, amount: line
    items with their part type.

    ``part`` is joined without a broadcast hint: it grows with the scale
    factor, so the choice is left to AQE's measured sizes."""
    return _lines_of(t, order_days(t).select("o_orderkey", "customer_id", "dt", "o_orderstatus"))


def _lines_of(t: Tables, o: DataFrame) -> DataFrame:
    """The line items of the orders ``o`` (o_orderkey and others): ``o``'s columns,
    module, qty, amount."""
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    part = t("part").select(F.col("p_partkey"), F.col("p_type").alias("module"))
    own = ["customer_id", "dt", *[c for c in o.columns if c not in ("customer_id", "dt")]]
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(part, li.l_partkey == part.p_partkey)
              .select(*own, "module", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount")))


# --------------------------------------------------------------------- care
# Fixed values of the employee binding: attribute lists picked by
# ``user_id % len(list)``; agent states by event type.
ORGS = ["kitchen", "hardware", "chat", "network", "payments", "integrations", "enterprise", "escalations",
        "sales", "back office"]
TEAMS = ["vendor a", "vendor b", "care", None]
ROLES = ["Senior Tier 1 Specialist", "Senior Tier 2 Expert", "Tier 1 Agent", "Tier 2 Agent",
         "SME Lead", "Manager"]
OFFICES = ["south", "east", "overseas"]
STATE_OF_EVENT = {"view": "Ready", "click": "On Call", "purchase": "After Call Work",
                  "signup": "On Hold", "error": "Not Ready"}


def _pick(values, key):
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (key % len(values)).cast("int") + 1)


def agent_email(user_id) -> "F.Column":
    """Mixed-case agent address (the directory stores it lower-cased)."""
    return F.concat(F.lit("Agent"), user_id.cast("string"), F.lit("@Care.Example"))


@_memo
def agent_state_log(t: Tables) -> DataFrame:
    """email, start_ts, state, seconds."""
    e = t("events")
    state = None
    for k, v in STATE_OF_EVENT.items():
        state = F.when(F.col("event_type") == k, F.lit(v)) if state is None else \
            state.when(F.col("event_type") == k, F.lit(v))
    return e.select(agent_email(F.col("user_id")).alias("email"), F.col("ts").alias("start_ts"),
                    state.alias("state"),
                    (F.col("value") * STATE_SECONDS_PER_VALUE).cast("int").alias("seconds"))


@_memo
def employee_daily(t: Tables) -> DataFrame:
    """One row per (employee, day) seen in events: email (lower case),
    employee_date, supervisory_org, team, high_level_role, office_location,
    role_start_date, employment_start_date, employment_end_date (last active
    day for every third employee, else null)."""
    e = t("events").select("user_id", F.to_date("ts").alias("employee_date")).distinct()
    span = e.groupBy("user_id").agg(F.min("employee_date").alias("first_day"),
                                    F.max("employee_date").alias("last_day"))
    u = F.col("user_id")
    return (e.join(span, "user_id").select(
        u.alias("employee_id"), F.lower(agent_email(u)).alias("email"), "employee_date",
        _pick(ORGS, u).alias("supervisory_org"), _pick(TEAMS, u).alias("team"),
        _pick(ROLES, u).alias("high_level_role"), _pick(OFFICES, u).alias("office_location"),
        F.col("first_day").alias("role_start_date"), F.col("first_day").alias("employment_start_date"),
        F.when(u % 3 == 0, F.col("last_day")).alias("employment_end_date")))


@_memo
def id_lists(t: Tables) -> DataFrame:
    """account_id, id_list: per customer a delimited list 'G-<custkey>',
    'N-<nationkey>', 'x<custkey % 7>' joined by one of ' ;:,/' (chosen by
    custkey % 5); every 13th customer has no list."""
    c = t("customer")
    k = F.col("c_custkey")
    delim = F.element_at(F.array(*[F.lit(x) for x in [" ", ";", ":", ",", "/"]]), (k % 5).cast("int") + 1)
    lst = F.concat(F.lit("G-"), k.cast("string"), delim,
                   F.lit("N-"), F.col("c_nationkey").cast("string"), delim,
                   F.lit("x"), (k % 7).cast("string"))
    return c.select(k.alias("account_id"), F.when(k % 13 != 0, lst).alias("id_list"))


@_memo
def parents(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """parent_id, parent_name, market_segment (region name),
    parent_first_go_live (earliest first order of its customers)."""
    n = t("nation").select(F.col("n_nationkey").alias("parent_id"), F.col("n_name").alias("parent_name"),
                           "n_regionkey")
    r = t("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("market_segment"))
    fg = customers(t, as_of).groupBy("parent_id").agg(F.min("first_order_date").alias("parent_first_go_live"))
    # nation/region are fixed-size dimensions (25 / 5 rows)
    return (n.join(F.broadcast(r), "n_regionkey").drop("n_regionkey")
             .join(fg, "parent_id", "left"))


@_memo
def nps_scores(t: Tables) -> DataFrame:
    """customer_id (= user_id), survey_date and nps_score = event_id % 11 of
    the latest signup event."""
    e = t("events").filter(F.col("event_type") == "signup")
    return e.groupBy(F.col("user_id").alias("customer_id")).agg(
        F.to_date(F.max("ts")).alias("survey_date"),
        F.max_by(F.col("event_id") % 11, F.struct("ts", "event_id")).cast("int").alias("nps_score"))


@_memo
def snapshot(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """The daily snapshot with every month end in it: customer_id, dt, status,
    volume.  The orders are sparse, so a month end between a customer's first
    order and churn (or ``as_of``) holds the latest row up to it.  The window
    holds one row per month of a customer."""
    d = daily(t).select("customer_id", "dt", "status", "volume")
    last = d.groupBy("customer_id", F.trunc("dt", "month").alias("month")).agg(
        F.max(F.struct("dt", "status", "volume")).alias("r"))
    c = customers(t).select("customer_id", "first_order_date", "churn_date").filter("first_order_date is not null")
    until = F.coalesce("churn_date", F.lit(as_of).cast("date"))
    months = c.select("customer_id", F.explode(F.sequence(
        F.trunc("first_order_date", "month"), F.trunc(until, "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"),
        until.alias("until")).filter(F.last_day("month") <= F.col("until"))
    w = Window.partitionBy("customer_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    ends = months.join(last, ["customer_id", "month"], "left").select(
        "customer_id", F.last_day("month").alias("dt"), F.last("r", ignorenulls=True).over(w).alias("r"))
    ends = ends.select("customer_id", "dt", "r.status", "r.volume")
    return d.filter(F.col("dt") != F.last_day("dt")).unionByName(ends)


@_memo
def monthly_book(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Monthly book of business: one row per customer and month with a live
    day, before the ``as_of`` month, for customers with a first order.
    service_model FSR for the FSR segments else QSR; every 10th customer is
    e-commerce; close date = first order - 30 days; guest ARR from the lowest
    priority, commerce ARR from the middle ones, xc ARR from backlog days."""
    cm = customer_month(t).filter(F.col("live_days") > 0)
    c = customers(t, as_of).select("customer_id", "segment", "first_order_date")
    svc = F.when(F.col("segment").isin(*FSR_SEGMENTS), "FSR").otherwise("QSR")
    ecomm = F.col("customer_id") % ECOMM_EVERY == 0
    close = F.date_sub("first_order_date", CLOSE_LEAD_DAYS)
    return (cm.join(c, "customer_id")
              .filter((F.col("month") < F.trunc(F.lit(as_of).cast("date"), "month")) &
                      F.col("first_order_date").isNotNull())
              .select("customer_id", "month", F.col("segment").alias("restaurant_type"),
                      svc.alias("service_model"), ecomm.alias("ecomm"),
                      F.when(ecomm, "E-Comm").otherwise(svc).alias("service_group"),
                      F.when(ecomm, "E-Comm").otherwise(F.concat(svc, F.lit(" - "), F.col("segment")))
                      .alias("full_type"),
                      F.col("first_order_date").alias("fod"), close.alias("close_date"),
                      F.trunc(close, "month").alias("close_month"), F.trunc(close, "quarter").alias("close_quarter"),
                      F.trunc("first_order_date", "quarter").alias("foq"),
                      (F.col("pos_saas_arr") + F.col("payments_arr")).alias("live_arr"),
                      F.col("payments_arr").alias("live_payments_arr"),
                      F.col("pos_saas_arr").alias("live_saas_arr"), "ec_saas_arr",
                      *[(F.round(a, 2) + 0.0).alias(n) for n, a in (       # whole cents, no negative zero
                          ("guest_saas_arr", F.col("annual_gmv") - F.col("annual_gpv")),
                          ("commerce_saas_arr", F.col("annual_gpv") - F.col("payments_arr")),
                          ("xc_saas_arr", F.col("annual_gmv") - F.col("pos_saas_arr") - F.col("ec_saas_arr")))],
                      F.col("volume").alias("gpv"), "margin", F.col("tx").alias("gpv_tx")))


@_memo
def customer_months(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Dense customer-month snapshot: every month from the first-order month
    to the churn month (or the ``as_of`` month); generated per customer, so
    its size is bounded by the calendar, not by a cross join."""
    c = customers(t, as_of).filter(F.col("first_order_date").isNotNull())
    end = F.trunc(F.coalesce("churn_date", F.lit(as_of).cast("date")), "month")
    return c.select("customer_id", "parent_id", "segment", "churn_date", "churn_reason", "first_order_date",
                    F.explode(F.sequence(F.trunc("first_order_date", "month"), end,
                                         F.expr("INTERVAL 1 MONTH"))).alias("month"))


# ------------------------------------------------------------ account cohorts
# Accounts are customers (C<key>), nations (N<key>) and regions (R<key>).  A
# customer's parent is its nation; customers of MOVED_SEGMENT belong to the next
# nation from MOVED_FROM on.  Nations of GRANDPARENT_REGIONS have the region as
# parent, the other nations and the regions are their own parents.  A nation's
# resellers sell to customers with a negative balance.
MOVED_SEGMENT, MOVED_FROM = "MACHINERY", "1998-07-01"
NATIONS = 25
GRANDPARENT_REGIONS = (0, 1)
PAYROLL_PRIORITY, NEW_PRIORITY, DOWN_PRIORITY = "3-MEDIUM", "1-URGENT", "5-LOW"


def _location(c="customer_id"):
    return F.concat(F.lit("C"), F.col(c).cast("string"))


def _nation_account(key):
    return F.concat(F.lit("N"), key.cast("string"))


def _nation_parent():
    return F.when(F.col("n_regionkey").isin(*GRANDPARENT_REGIONS), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))) \
        .otherwise(_nation_account(F.col("n_nationkey")))


@_memo
def account_days(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Daily account snapshot: account_id, dt, status, live_amount (the day's
    volume of live days).  An account that churns has a row on that day."""
    d = daily(t).select(_location().alias("account_id"), "dt", "status",
                        F.when(F.col("status") == "Live", F.col("volume")).otherwise(0.0).alias("live_amount"))
    gone = customer_ends(t, as_of).filter("churn_date is not null").select(
        _location().alias("account_id"), F.col("churn_date").alias("dt"), F.lit("Churn").alias("status"),
        F.lit(0.0).alias("live_amount"))
    return d.unionByName(gone)


@_memo
def account_snapshots(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Monthly snapshot of all accounts: month, account_id, customer_id,
    parent_account_id, rsm_id, segment, first_order_date."""
    return location_snapshots(t, as_of).unionByName(parent_snapshots(t, as_of))


@_memo
def location_snapshots(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """The customers' rows of the monthly snapshot."""
    c = t("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("parent_id"),
                             F.col("c_mktsegment").alias("segment")).join(customer_ends(t, as_of), "customer_id")
    end = F.trunc(F.coalesce("churn_date", F.lit(as_of).cast("date")), "month")
    cm = c.withColumn("month", F.explode(F.sequence(F.trunc("first_order_date", "month"), end, F.expr("INTERVAL 1 MONTH"))))
    moved = (F.col("segment") == MOVED_SEGMENT) & (F.col("month") >= F.lit(MOVED_FROM).cast("date"))
    return cm.select("month", _location().alias("account_id"), F.col("customer_id"), _nation_account(
        F.when(moved, (F.col("parent_id") + 1) % NATIONS).otherwise(F.col("parent_id"))).alias("parent_account_id"),
        F.lit(None).cast("string").alias("rsm_id"), "segment", "first_order_date")


@_memo
def parent_snapshots(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """The nations' and regions' rows: a row per month each."""
    lo = t("orders").agg(F.trunc(F.min("o_orderdate"), "month").alias("lo"))
    months = F.explode(F.sequence(lo.scalar(), F.trunc(F.lit(as_of).cast("date"), "month"), F.expr("INTERVAL 1 MONTH"))).alias("month")
    n, r = t("nation"), t("region")
    no_date = F.lit(None).cast("date").alias("first_order_date")
    # fixed-size dimensions: a row per month each
    nations = n.select(months, _nation_account(F.col("n_nationkey")).alias("account_id"),
                       (-1 - F.col("n_nationkey")).cast("long").alias("customer_id"), _nation_parent().alias("parent_account_id"),
                       F.concat(F.lit("RSM"), (F.col("n_nationkey") % 7).cast("string")).alias("rsm_id"),
                       F.col("n_name").alias("segment"), no_date)
    regions = r.select(months, F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("account_id"),
                       (-1001 - F.col("r_regionkey")).cast("long").alias("customer_id"),
                       F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("parent_account_id"),
                       F.lit("RSM7").alias("rsm_id"), F.col("r_name").alias("segment"), no_date)
    return nations.unionByName(regions)


@_memo
def account_directory(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Accounts as of now: account_id, parent_account_id, reseller, churn_reason."""
    key = F.when(F.col("segment") == MOVED_SEGMENT, (F.col("parent_id") + 1) % NATIONS).otherwise(F.col("parent_id"))
    reseller = F.when(F.col("acctbal") < 0, F.concat(F.lit("Reseller "), F.col("parent_id").cast("string")))
    c = t("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("parent_id"),
                             F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"))
    c = c.join(customer_ends(t, as_of).select("customer_id", "churn_date"), "customer_id", "left")
    why = F.when(F.col("churn_date").isNotNull(), F.when(F.col("segment") == COMPETITOR_SEGMENT, "Competitor").otherwise("Other"))
    locations = c.select(_location().alias("account_id"), _nation_account(key).alias("parent_account_id"), reseller.alias("reseller"),
                         why.alias("churn_reason"))
    none = F.lit(None).cast("string")
    nations = t("nation").select(_nation_account(F.col("n_nationkey")).alias("account_id"), _nation_parent().alias("parent_account_id"),
                                 none.alias("reseller"), none.alias("churn_reason"))
    return locations.unionByName(nations)


@_memo
def account_opportunities(t: Tables) -> DataFrame:
    """An opportunity per order: won unless pending; its seller goes by the day
    of the week; 3-MEDIUM is payroll of an existing customer, 1-URGENT new
    business, the others upsell; 5-LOW takes its price away and, when fulfilled,
    sells hardware for twice the price."""
    o, p = order_days(t), F.col("o_orderpriority")
    price = F.col("o_totalprice")
    return o.select(
        _location().alias("account_id"), F.col("dt").alias("close_date"), (F.col("o_orderstatus") != "P").alias("is_won"),
        F.concat(F.lit("Seller "), F.dayofweek("dt").cast("string")).alias("owner_id"),
        F.when(p.isin(PAYROLL_PRIORITY, NEW_PRIORITY), "New Business").otherwise("Existing Business (Upsell)").alias("opp_type"),
        F.when(p == PAYROLL_PRIORITY, "Payroll").otherwise("Software").alias("record_type"),
        F.when(p == NEW_PRIORITY, "New Customer").otherwise("Existing Customer").alias("business"),
        F.when(p == DOWN_PRIORITY, -price).otherwise(price).alias("software_mrr"),
        F.when((p == DOWN_PRIORITY) & (F.col("o_orderstatus") == "F"), price * 2).otherwise(0.0).alias("hardware_cost"))


@_memo
def account_products(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Product status by day: account_id, dt, product, saas_price, churn_date,
    first_order_date; a churned account's last products stand on its churn day."""
    # the orders know their customer's dates before they meet the line items: who
    # asks for some days joins the lines of those days' orders
    ends = ["first_order_date", "last_order_date", "churn_date"]
    o = order_days(t).select("o_orderkey", "customer_id", "dt").join(customer_ends(t, as_of), "customer_id")
    lines = _lines_of(t, o).groupBy("customer_id", "dt", "module", *ends).agg(F.sum("amount").alias("saas_price"))
    gone = lines.filter((F.col("dt") == F.col("last_order_date")) & F.col("churn_date").isNotNull()).withColumn("dt", F.col("churn_date"))
    both = lines.unionByName(gone)
    return both.select(_location().alias("account_id"), "dt", F.col("module").alias("product"), "saas_price", "churn_date",
                       "first_order_date")


# ------------------------------------------------------- tickets and devices
TICKET_EVENT, DEVICE_EVENT = "error", "click"


@_memo
def tickets(t: Tables, start: str, end: str) -> DataFrame:
    """customer_id (= user_id), ticket_count: error events in [start, end)."""
    e = t("events").filter((F.col("event_type") == TICKET_EVENT) &
                           (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                           (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return e.groupBy(F.col("user_id").alias("customer_id")).agg(F.count("event_id").alias("ticket_count"))


@_memo
def devices(t: Tables, start: str, mid: str, end: str) -> DataFrame:
    """customer_id, period (1: [start, mid), 2: [mid, end)), devices =
    distinct device keys (``props``) of click events."""
    e = t("events").filter((F.col("event_type") == DEVICE_EVENT) &
                           (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                           (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    period = F.when(F.col("ts") < F.lit(mid).cast("timestamp_ntz"), 1).otherwise(2)
    return e.groupBy(F.col("user_id").alias("customer_id"), period.alias("period")).agg(
        F.count_distinct("props").alias("devices"))
