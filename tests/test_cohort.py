"""Cohort drivers, period growth on sparse rows, the saved cohort table."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from cohortix.operators.joins import asof_lookup, hierarchy
from cohortix.plans import cohort as co
from cohortix.sources import MonthTable

D = dt.date
SNAP = ("month date, account_id string, customer_id long, parent_account_id string, rsm_id string, segment string, "
        "first_order_date date")
ACC = "account_id string, parent_account_id string, reseller string, churn_reason string"
OPP = ("account_id string, close_date date, is_won boolean, owner_id string, opp_type string, record_type string, business string, "
       "software_mrr double, hardware_cost double")
STATUS = "account_id string, dt date, saas_price double, churn_date date, first_order_date date"
UP = "Existing Business (Upsell)"


def inputs(spark):
    jan, feb = D(2020, 1, 1), D(2020, 2, 1)
    first = {"L1": D(2020, 1, 5), "L2": D(2019, 6, 1), "L3": None}
    snap = []
    for m in (jan, feb):
        parent = {"L1": "P1", "L2": "P1" if m == jan else "P2", "L3": "P2"}
        snap += [(m, a, 1, parent[a], None, "s", first[a]) for a in first]
        snap += [(m, "P1", 11, "G", "r", "s", None), (m, "P2", 12, "P2", "r", "s", None), (m, "G", 13, "G", "r", "big", None)]
    daily = spark.createDataFrame([
        ("L1", D(2020, 1, 5), "Live", 10.0), ("L2", D(2020, 1, 5), "Live", 20.0), ("L3", D(2020, 1, 5), "Backlog", 0.0),
        ("L2", D(2020, 2, 7), "Live", 30.0), ("L1", D(2020, 2, 7), "Churn", 0.0), ("L4", D(2020, 1, 5), "Live", 99.0)],
        "account_id string, dt date, status string, live_amount double")
    accounts = spark.createDataFrame([("L1", "P1", None, "COMPETITOR"), ("L2", "P2", None, None), ("L3", "P2", "Bad", "Other"),
                                      ("P1", "G", None, None), ("P2", "P2", None, None)], ACC)
    opps = spark.createDataFrame([
        ("L2", D(2020, 2, 7), True, "x", UP, "Software", "Existing Customer", 5.0, 0.0),
        ("L2", D(2020, 2, 7), True, "x", UP, "Software", "Existing Customer", -3.0, 1.0),
        ("L2", D(2020, 2, 7), True, "x", UP, "Software", "Existing Customer", -2.0, 4.0),       # 2 * -2 + 4 >= 0: upsell of -2
        ("L2", D(2020, 2, 7), True, "bad", UP, "Software", "Existing Customer", 100.0, 0.0),
        ("L2", D(2020, 2, 7), False, "x", UP, "Software", "Existing Customer", 100.0, 0.0),
        ("L2", D(2020, 2, 7), True, "x", "New Business", "Payroll", "Existing Customer", 100.0, 0.0),
        ("L1", D(2020, 1, 9), True, "x", "New Business", "Software", "New Customer", 100.0, 0.0)], OPP)
    status = spark.createDataFrame([("L1", D(2020, 2, 7), 4.0, D(2020, 2, 7), D(2020, 1, 5)), ("L1", D(2020, 2, 7), 3.0, D(2020, 2, 7), D(2020, 1, 5)),
                                    ("L3", D(2020, 2, 7), 9.0, D(2020, 2, 7), None), ("L1", D(2020, 1, 5), 4.0, D(2020, 2, 7), D(2020, 1, 5))], STATUS)
    return daily, spark.createDataFrame(snap, SNAP), accounts, opps, status


RULES = co.CohortRules(excluded_resellers=("Bad",), excluded_sellers=("bad",))
COLS = ("dt", "account_id", "location_count", "live_saas_arr", "new_live_saas", "upsell_saas_arr", "downsell_saas_arr", "churned_saas_arr",
        "preventable_churn_arr", "non_preventable_churn_arr")


def rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def test_direct_children_report_the_flows(spark):
    got = rows(co.cohort_drivers(*inputs(spark), RULES))
    assert got == [
        # L4 has no snapshot, L3 a dropped reseller; L1's first day is new ARR;
        # G's only child, P1, has no competitor churn: that kind is 0
        (D(2020, 1, 5), "G", 2, 360.0, 120.0, None, None, None, 0.0, None),
        (D(2020, 2, 7), "G", 0, 0.0, None, None, None, None, 0.0, None),
        # L2 moved to P2 in February, where opportunities of P2's children count
        (D(2020, 2, 7), "P2", 1, 360.0, None, 36.0, -36.0, None, 0.0, None)]


def test_flows_roll_up_two_levels(spark):
    got = {(r[0], r[1]): r[5:] for r in rows(co.cohort_drivers(*inputs(spark), RULES, levels=2))}
    # L1 (competitor, in any case) churned below G; L2 was below G in January, so G has children of both kinds
    assert got[(D(2020, 2, 7), "G")] == (None, None, 84.0, 84.0, 0.0)
    assert got[(D(2020, 2, 7), "P2")] == (36.0, -36.0, None, 0.0, None)


def test_hierarchy_by_month(spark):
    daily, snaps, *_ = inputs(spark)
    up = hierarchy(snaps, "account_id", "parent_account_id", "month")
    got = {(r.month, r.account_id): r.parent_2 for r in up.collect()}
    assert got[(D(2020, 1, 1), "L2")] == "G" and got[(D(2020, 2, 1), "L2")] == "P2"


def test_asof_lookup(spark):
    rows_ = spark.createDataFrame([("a", 2, 10.0, 1.0), ("a", 5, None, 2.0), ("b", 3, 30.0, 4.0)], "k string, t int, v double, f double")
    probes = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("a", 4, "r"), ("a", 9, "s"), ("a", 9, "s"), ("c", 9, "t"), (None, 1, "u")],
                                   "k string, t int, name string")
    got = sorted((r.name, r.row_t, r.v, r.cum_f) for r in asof_lookup(probes, rows_, ["k"], "t", ["v"], ["f"]).collect())
    # a null value of the last row stays null: the row is looked up, not the value
    assert got == [("p", None, None, None), ("q", 2, 10.0, 1.0), ("r", 2, 10.0, 1.0), ("s", 5, None, 3.0), ("s", 5, None, 3.0),
                   ("t", None, None, None), ("u", None, None, None)]


def test_period_growth_on_sparse_rows(spark):
    schema = "account_id string, dt date, live_saas_arr double, location_count long, " + ", ".join(f"{f} double" for f in co.FLOWS)
    data = [("a", D(2020, 1, 1), 100.0, 1, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("a", D(2020, 1, 20), 130.0, 2, None, 30.0, 0.0, 0.0, 0.0, 0.0),
            ("a", D(2020, 2, 25), 110.0, 1, 0.0, 0.0, -5.0, 15.0, 15.0, 0.0), ("b", D(2020, 2, 10), 50.0, 0, 0.0, 7.0, 0.0, 0.0, 0.0, 0.0)]
    g = co.period_growth(spark.createDataFrame(data, schema), "2020-03-15", lengths=(30,))
    got = {(r.month, r.period_type): r for r in g.collect()}
    r = got[(D(2020, 1, 1), "forward")]         # 1 Jan .. 31 Jan
    assert (r.period_start_saas, r.period_end_saas, r.new_location, r.upsell, r.churn) == (100.0, 130.0, 100.0, 30.0, 0.0)
    assert r.cohort_growth == 230.0 and r.effective_days == 30
    r = got[(D(2020, 2, 1), "forward")]         # the stock of 20 January stands; b has no location
    assert (r.period_start_saas, r.period_end_saas, r.upsell, r.downsell, r.churn) == (130.0, 110.0, 0.0, -5.0, 15.0)
    r = got[(D(2020, 3, 1), "forward")]         # cut at as_of
    assert (r.period_end, r.effective_days, r.period_end_saas) == (D(2020, 3, 14), 13, 110.0)
    assert (D(2020, 3, 1), "lookback") in got and got[(D(2020, 2, 1), "lookback")].period_start == D(2020, 1, 30)
    # the January lookback starts on 1 January, with the first row
    assert got[(D(2020, 1, 1), "lookback")].period_start == D(2020, 1, 1)


def test_no_day_grid_and_no_range_join_in_period_growth(spark):
    from cohortix.catalog import QUERIES

    from .conftest import SF001
    plan = QUERIES["m44_period_growth"](spark, SF001)._jdf.queryExecution().toString()
    assert "INTERVAL '1' DAY" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_month_table_rewrites_only_given_months(spark, tmp_path):
    path = str(tmp_path / "t")
    table = MonthTable(spark, path)
    df = spark.createDataFrame([(D(2020, m, d), m * d) for m in (1, 2, 3) for d in (1, 15, 28)] + [(None, 0)], "dt date, v int")
    table.create(df)
    before = files(path)
    table.replace(spark.createDataFrame([(D(2020, 2, 9), -1)], "dt date, v int"), ["2020-02-01"])
    after = files(path)
    kept = {f for f in before if "2020-02-01" not in f}
    assert kept and all(after[f] == before[f] for f in kept) and not any(f in after for f in before if "2020-02-01" in f)
    assert sorted(r.v for r in table.read(months=["2020-02-01"]).collect()) == [-1]
    assert table.read().count() == 8 and table.read("2020-02-01", "2020-02-01").count() == 1
    # a month whose rows are gone becomes empty, the others stay
    table.replace(spark.createDataFrame([], "dt date, v int"), ["2020-03-01"])
    assert table.read("2020-03-01").count() == 0 and table.read().count() == 5


def test_month_table_refuses_stray_rows_and_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    table = MonthTable(spark, path)
    df = spark.createDataFrame([(D(2020, 1, 1), 1), (D(2020, 2, 1), 2)], "dt date, v int")
    table.create(df)
    with pytest.raises(Exception, match="outside the replaced months"):
        table.replace(df, ["2020-01-01"])
    assert table.read().count() == 2        # nothing was replaced
    with pytest.raises(ValueError):
        table.replace(df, ["2020-01-15"])
    plan = table.read("2020-02-01")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "month_part" in plan.split("PartitionFilters", 1)[1][:200]
    assert table.read("2020-02-01").filter(F.col("v") == 2).inputFiles()


def test_snapshots_meet_days_by_year(spark):
    """A repeated snapshot row counts as often as it stands; a snapshot in mid-month
    and an unknown month meet no day; parts of a year may have other parents."""
    _, snaps, *_ = inputs(spark)
    odd = spark.createDataFrame([(D(2020, 1, 1), "L1", 1, "P1", None, "s", D(2020, 1, 5)), (D(2020, 3, 9), "L1", 1, "P9", None, "s", None),
                                 (None, "L1", 1, "P9", None, "s", None)], SNAP)
    by_year = co._by_year(snaps.unionByName(odd), "parent_account_id")
    assert {(r.account_id, r.parent_account_id): r.n[:3] for r in by_year.collect() if r.account_id in ("L1", "L2")} == {
        ("L1", "P1"): [2, 1, 0], ("L2", "P1"): [1, 0, 0], ("L2", "P2"): [0, 1, 0]}
    days = spark.createDataFrame([("L1", D(2020, 1, 5)), ("L2", D(2020, 2, 7)), ("L1", D(2020, 3, 9)), ("L1", None)], "account_id string, dt date")
    assert sorted((r.account_id, r.dt, r.parent_account_id, r.held) for r in co._on_day(days, by_year).collect()) == [
        ("L1", D(2020, 1, 5), "P1", 2), ("L2", D(2020, 2, 7), "P2", 1)]


def test_chain_is_read_from_the_parents_alone(spark):
    daily, snaps, accounts, opps, status = inputs(spark)
    parents = snaps.filter("account_id in ('P1', 'P2', 'G')")
    saved = []
    got = co.cohort_drivers(daily, snaps, accounts, opps, status, RULES, 2, parents, lambda df: saved.append(df) or df)
    assert rows(got) == rows(co.cohort_drivers(daily, snaps, accounts, opps, status, RULES, levels=2))
    assert len(saved) == 3      # what is read more than once


def test_grandparent_plan_is_small(spark):
    """The saved flows keep the last plan small, on which the driver's memory depends."""
    from cohortix.catalog import QUERIES

    from .conftest import SF001
    plan = QUERIES["m43_cohort_drivers_grandparent"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 20


def test_a_restated_month_computes_the_flows_once(spark, monkeypatch):
    from cohortix import catalog

    from .conftest import SF001
    calls, real = [], co.account_flows
    monkeypatch.setattr(co, "account_flows", lambda *a: calls.append(a) or real(*a))
    catalog._saved_cohort(spark, SF001)
    assert len(calls) == 1
