"""Care operations: occupancy (M50), attrition (M51), identity health check
(M49), managed location counts (M52)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import div0
from ..operators.aggregates import conditional_distinct
from ..operators.joins import hour_split
from ..sources.spines import hour_spine

@dataclass(frozen=True)
class Labels:
    """What a site calls its groups; every value is the caller's.

    campaigns: org -> campaign; vendor_campaigns: the same, for one vendor's
    team only (``vendor``); outsourced: teams reported under their own name;
    roles: (pattern, label), first match wins; other: label of an unknown
    campaign."""
    campaigns: dict[str, str]
    outsourced: tuple[str, ...]
    roles: tuple[tuple[str, str], ...]
    ready: tuple[str, ...]
    handle: tuple[str, ...]
    other: str = "Other"
    vendor: str = ""
    vendor_campaigns: dict[str, str] = field(default_factory=dict)
    excluded: tuple[str, ...] = ()


def _map(c, mapping):
    if not mapping:
        return F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, c)


def role_label(c: Column, roles) -> Column:
    out = F.lit("Other")
    for pattern, label in reversed(roles):
        out = F.when(c.ilike(pattern), F.lit(label)).otherwise(out)
    return out


def _campaign(org: Column, team: Column, labels: Labels) -> Column:
    return F.coalesce(_map(org, labels.campaigns),
                      F.when(team == labels.vendor, _map(org, labels.vendor_campaigns)), F.lit(labels.other))


def occupancy(states: DataFrame, employees: DataFrame, start: str, end: str, labels: Labels) -> DataFrame:
    """Ready and handle seconds per clock hour x campaign x site x role.

    states: email, start_ts, state, seconds.  employees: email (lower case),
    employee_date, supervisory_org, team, high_level_role.
    Hours without any state give one zero row labelled with the fallbacks.
    """
    spark = states.sparkSession
    hours = hour_spine(spark, start, end, "hour")
    lo = F.to_timestamp_ntz(F.lit(start))
    hi = F.to_timestamp_ntz(F.lit(end)) + F.expr("INTERVAL 23 HOURS")
    # an interval that ends before the range or starts after it has no hour in
    # it; the start bound reaches the scan
    near = states.filter((F.col("start_ts") < hi + F.expr("INTERVAL 1 HOUR")) & (
        F.col("start_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("seconds").cast("decimal(18,6)")) >= lo))
    pieces = (hour_split(near, "start_ts", "seconds", "hour", "time_in_hour")
              .filter(F.col("hour").between(lo, hi))
              .withColumn("email_key", F.lower("email"))
              .withColumn("employee_date", F.to_date("hour")))
    emp = employees.select(F.col("email").alias("email_key"), "employee_date", "supervisory_org",
                           "team", "high_level_role")
    j = pieces.join(emp, ["email_key", "employee_date"], "left")
    campaign = _campaign(F.col("supervisory_org"), F.col("team"), labels)
    site = (F.when(F.col("team").isin(*labels.outsourced), F.col("team"))
             .when(F.col("team").isNotNull(), F.lit("Internal")).otherwise(F.lit("Other")))
    agg = j.groupBy("hour", campaign.alias("campaign"), site.alias("site"),
                    role_label(F.col("high_level_role"), labels.roles).alias("role")).agg(
        F.sum(F.when(F.col("state").isin(*labels.ready), F.col("time_in_hour")).otherwise(0)).alias("ready_time"),
        F.sum(F.when(F.col("state").isin(*labels.handle), F.col("time_in_hour")).otherwise(0)).alias("handle_time"))
    # the hour spine is bounded by the date range; the aggregate is hour x
    # labels.  Left join keeps hours without states.
    out = hours.join(agg, "hour", "left").select(
        "hour", F.coalesce("campaign", F.lit(labels.other)).alias("campaign"),
        F.coalesce("site", F.lit("Other")).alias("site"),
        F.coalesce("role", F.lit("Other")).alias("role"),
        F.coalesce("ready_time", F.lit(0)).cast("long").alias("ready_time"),
        F.coalesce("handle_time", F.lit(0)).cast("long").alias("handle_time"))
    return out.withColumn("occupancy", F.round(div0(F.col("handle_time"),
                                                    F.col("handle_time") + F.col("ready_time")), 6))


def attrition(employees: DataFrame, start: str, end: str, labels: Labels, office: str,
              office_end: str | None = None) -> DataFrame:
    """Monthly leavers by cause, average daily headcount and attrition rate.

    employees: email, employee_date, supervisory_org, team, high_level_role,
    office_location, role_start_date, employment_end_date.
    The next-day headcount flag is computed before the date filter; a
    missing next day counts as leaving.
    """
    office_end = office_end or end
    e = employees.filter(~F.col("supervisory_org").isin(*labels.excluded))
    team = F.col("team")
    campaign = _campaign(F.col("supervisory_org"), team, labels)
    role = role_label(F.col("high_level_role"), labels.roles)
    site = F.when(team.isin(*labels.outsourced), team).otherwise(F.lit("Internal"))
    b = (e.withColumn("in_hc", (role != "Other") & (campaign != labels.other))
          .withColumn("site", site)
          .filter((F.col("employee_date") >= F.col("role_start_date")) &
                  ((F.col("employee_date") <= F.col("employment_end_date")) |
                   F.col("employment_end_date").isNull())))
    # one row per employee-day: the window holds at most one row per day
    w = Window.partitionBy("email").orderBy("employee_date")
    b = b.withColumn("next_in_hc", F.lead("in_hc").over(w))
    d = b.filter(F.col("employee_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    leaver = F.col("in_hc") & (~F.col("next_in_hc") | F.col("next_in_hc").isNull()) & F.col("email").isNotNull()
    ee = F.col("employment_end_date")
    d = d.withColumn("site_grouped", F.when(F.col("site") == "Internal", "Internal").otherwise("BPO"))
    daily = conditional_distinct(d, ["site_grouped", "employee_date"], "email", {
        "hc": F.col("in_hc"),
        "leavers": leaver,
        "leavers_company": leaver & (ee == F.col("employee_date")),
        "leavers_finance_hc": leaver & (ee.isNull() | (ee > F.col("employee_date"))),
        "leavers_office": leaver & (ee == F.lit(office_end).cast("date")) &
                          (F.col("office_location") == office)})
    m = daily.groupBy(F.trunc("employee_date", "month").alias("month"), "site_grouped").agg(
        F.sum("leavers").alias("leavers_total"), F.sum("leavers_company").alias("leavers_company"),
        F.sum("leavers_finance_hc").alias("leavers_finance_hc"),
        F.round(F.avg("hc"), 0).alias("avg_daily_headcount"),
        F.sum("leavers_office").alias("leavers_office"))
    return m.withColumn("attrition", F.round(div0(F.col("leavers_total"), F.col("avg_daily_headcount")), 6))


def unmatched_identities(lists: DataFrame, directory: DataFrame, since: str) -> DataFrame:
    """Identities on the tagged outsourced lists, from ``since`` on, that
    name no directory user (case-insensitive), or one whose e-mail is missing.

    lists: as_of, email, source.  directory: username, email."""
    known = directory.filter(F.col("email").isNotNull()).select(F.lower("username").alias("k"))
    recent = lists.filter((F.col("as_of") >= F.lit(since).cast("date")) & F.col("email").isNotNull())
    miss = recent.withColumn("k", F.lower("email")).join(known, "k", "left_anti")
    return (miss.groupBy("as_of", "source", "email").agg(F.count(F.lit(1)).alias("n"))
                .withColumns({"is_pending": F.col("email") == "Pending", "is_email": F.col("email").contains("@")}))


def managed_counts(customers: DataFrame, managers: DataFrame, unmanaged: str = "No RSM") -> DataFrame:
    """Distinct accounts per manager and segment, of accounts that have
    ordered and not churned; a missing manager, or the placeholder
    ``unmanaged``, is 'Unmanaged'.

    customers: account_id, segment, manager_id, first_order_date, churn_date."""
    j = customers.filter("first_order_date is not null and churn_date is null").join(managers, "manager_id", "left")
    name = F.when(F.col("manager_name").isNull() | (F.col("manager_name") == unmanaged),
                  F.lit("Unmanaged")).otherwise(F.col("manager_name"))
    return j.groupBy(name.alias("manager"), "segment").agg(
        F.count_distinct("account_id").alias("accounts"))
