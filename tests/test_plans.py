"""Pipeline invariants and decisions on hand-sized frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortix.plans import subscription as sub
from cohortix.plans.series import align_series, resample_curve, spline_eval
from cohortix.plans.uplift import adopter_uplift


def d(y, m, day=1):
    return dt.date(y, m, day)


def _panel(spark):
    rows = []
    for k, base in (("a", 100.0), ("b", 50.0)):
        for i in range(14):
            m = d(2020 + (i // 12), i % 12 + 1)
            if k == "b" and i == 13:
                continue
            rows.append((k, m, base + i, 0.0, 10.0, base * 2, base))
    return spark.createDataFrame(rows, "customer_id string, month date, pos_saas_arr double, "
                                       "ec_saas_arr double, payments_arr double, annual_gmv double, "
                                       "annual_gpv double")


def test_gross_never_exceeds_net(spark):
    p = sub.with_twelve_month_twin(_panel(spark), ["customer_id"])
    net = {r.month: r for r in sub.retention(p, "net").collect()}
    gross = {r.month: r for r in sub.retention(p, "gross").collect()}
    for m in net:
        if net[m].saas_rr is not None:
            assert gross[m].saas_rr <= net[m].saas_rr + 1e-12
    jan = net[d(2020, 1)]
    assert jan.live_pos_saas == 150.0 and jan.live_pos_saas_12 == 112.0 + 62.0


def test_churn_policy(spark):
    df = spark.createDataFrame([
        ("Live", None, None), ("Live", "Churn", None), ("Backlog", None, "Competitor"), ("Churn", None, None)],
        "status string, status_12 string, churn_reason string")
    assert sub.apply_churn_policy(df, "keep").count() == 3
    assert sub.apply_churn_policy(df, "remove").count() == 1


def test_explode_ids(spark):
    df = spark.createDataFrame([(1, "a-1,b-2"), (2, "c-3; d-4"), (3, "e-5"), (4, None), (5, "junk a-1")],
                               "acct int, ids string")
    got = sorted((r.guid, r.acct) for r in sub.explode_ids(df, "ids", "acct").collect())
    assert got == [("a-1", 1), ("a-1", 5), ("b-2", 1), ("c-3", 2), ("d-4", 2), ("e-5", 3)]


def test_revenue_share_tiers(spark):
    rows = [("c%d" % i, d(2021, 11), 1, 0, 10, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "customer_id string, month date, tds_tx long, dd_tx long, gh_tx long, ue_tx long")
    sched = sub.ShareSchedule(tds_edges=(2, 5, 10, 20), gh_edges=(20, 40))
    r = sub.revenue_share(df, sched).first()
    assert r.tds_mult == 0.81 and r.gh_mult == 0.10 and r.dd_mult == 0.17
    assert r.rev_share_arr == round(1 * 0.81 * 12 + 10 * 0.10 * 12, 2)


def test_uplift_skips_single_group_slices(spark):
    rows = [(i, d(2020, 1), float(i), 1.0) for i in range(6)] + \
           [(i, d(2020, 1), float(-i), 0.0) for i in range(6, 12)] + \
           [(i, d(2020, 4), float(i), 1.0) for i in range(12, 15)]
    df = spark.createDataFrame(rows, "customer_id int, quarter date, gmv_pd_growth_pct double, x_change double")
    out = adopter_uplift(df, ["x"], with_p=True).collect()
    assert len(out) == 1 and out[0].quarter == d(2020, 1)
    assert out[0].n_added == 6 and 0 <= out[0].p_value <= 1


def test_align_and_resample(spark):
    df = spark.createDataFrame([("g1", d(2020, 1), 1.0), ("g1", d(2020, 3), 3.0), ("g2", d(2020, 2), 5.0),
                                ("g2", d(2020, 4), 2.0), ("g2", d(2020, 5), 1.0)],
                               "g string, x date, y double")
    a = align_series(df, "x", "y", "g")
    got = {(r.g, r.pos): r.y for r in a.collect()}
    assert got[("g1", 1)] == 1.0            # forward filled
    assert got[("g1", 3)] is None           # after the group's last x -> masked
    assert got[("g2", 0)] is None           # before the group's first x -> masked
    rs = resample_curve(a, "g", "pos", "y", 20).collect()
    assert len([r for r in rs if r.g == "g2"]) == 5 * 20 - 19
    xs = np.array([0.0, 1.0, 2.0, 3.0, 4.0])
    ys = xs ** 3 - 2 * xs
    assert np.allclose(spline_eval(xs, ys, np.array([0.5, 2.5, 3.7])), np.array([0.5, 2.5, 3.7]) ** 3
                       - 2 * np.array([0.5, 2.5, 3.7]))


@pytest.mark.parametrize("degree", [1, 2, 3, 4, 5])
def test_splines_of_any_degree(degree):
    """Polynomials of the degree come back; the points are met; inner derivatives
    up to degree - 1 are continuous; columns are solved as they are alone."""
    rng = np.random.default_rng(degree)
    xs = np.cumsum(rng.uniform(0.5, 2.0, 15))
    xn = np.linspace(xs[0], xs[-1], 101)
    poly = np.polynomial.Polynomial(rng.normal(size=degree + 1))
    assert np.allclose(spline_eval(xs, poly(xs), xn, degree), poly(xn), rtol=1e-7, atol=1e-7 * abs(poly(xs)).max())
    ys = rng.normal(size=(15, 3))
    out = spline_eval(xs, ys, xs, degree)
    assert np.allclose(out, ys)
    assert np.allclose(spline_eval(xs, ys, xn, degree)[:, 1], spline_eval(xs, ys[:, 1], xn, degree))
    if degree > 1:
        e = 1e-5
        for x in xs[2:-2]:
            f = spline_eval(xs, ys[:, 0], np.array([x - 2 * e, x - e, x + e, x + 2 * e]), degree)
            assert abs((f[1] - f[0]) / e - (f[3] - f[2]) / e) < 1e-2


def test_spline_is_linear_in_its_points():
    import time
    n = 20_000
    xs = np.arange(n, dtype=float)
    t = time.perf_counter()
    y = spline_eval(xs, np.sin(xs / 50), xs + 0.5, 3)
    assert time.perf_counter() - t < 20 and np.allclose(y[5:-5], np.sin((xs + 0.5) / 50)[5:-5], atol=1e-6)     # n x n: 3 GB


def test_resample_keeps_short_series_and_gaps(spark):
    rows = [("a", k, float(k * k)) for k in range(6)] + [("b", k, None if k in (0, 5) else 2.0 * k) for k in range(6)] + [("c", 0, 1.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, pos int, y double").repartition(3)
    out = {}
    for r in resample_curve(df, "g", "pos", "y", 4, degree=2).collect():
        out.setdefault(r.g, []).append((r.x, r.y))
    a = sorted(out["a"])
    assert len(a) == 21 and all(abs(y - x * x) < 1e-9 for x, y in a)
    b = dict(out["b"])
    assert b[0.75] is None and b[4.25] is None and b[1.0] == pytest.approx(2.0) and sorted(out["c"]) == [(0.0, 1.0), (1.0, None)]


def test_module_state_windows(spark):
    from cohortix.plans.tickets import module_state
    rows = [(1, d(1998, 12, 1), "promo"), (1, d(1999, 2, 1), "promo"), (1, d(1999, 3, 1), "small"),
            (2, d(1998, 1, 1), "promo"), (2, d(1999, 8, 1), "small"), (3, d(1998, 10, 1), "large")]
    lines = spark.createDataFrame(rows, "customer_id int, dt date, module string")
    got = {r.customer_id: r for r in module_state(lines, "1999-01-01", "1999-07-01",
                                                  ["promo", "small", "large"]).collect()}
    assert got[1].start_mods == 1 and got[1].promo == 1 and got[1].small == 1 and got[1].large is None
    assert 2 not in got                      # both rows outside the windows
    assert got[3].start_mods == 1 and got[3].large is None


def test_investor_months_follow_the_table(spark, tmp_path):
    import shutil

    from cohortix.catalog import QUERIES

    sf = str(tmp_path)
    for name in ("customer", "nation", "region"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", sf)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(20)
    first, other = [r["c_custkey"] for r in spark.read.parquet(f"{sf}/customer.parquet").orderBy("c_custkey").limit(2).collect()]
    early = lambda key, day: orders.limit(1).withColumn("o_custkey", F.lit(key).cast(orders.schema["o_custkey"].dataType)).withColumn(
        "o_orderdate", F.lit(day).cast(orders.schema["o_orderdate"].dataType)).withColumn("o_orderstatus", F.lit("F"))
    early(first, "1993-11-05").unionByName(early(other, "1994-02-07")).unionByName(early(other, "2002-01-03")).write.parquet(
        f"{sf}/orders.parquet")
    out = QUERIES["m12_investor_wide"](spark, sf)
    months = sorted({c[:7] for c in out.columns if c.endswith("_status")})
    assert months == ["1993_11", "1993_12", "1994_01", "1994_02"]      # 2002 lies behind AS_OF
    rows = {r["customer_id"]: r for r in out.collect()}
    assert rows[first]["1993_11_status"] and rows[other]["1994_02_status"] and not rows[other]["1993_11_status"]
    empty = sub.month_axis(spark.createDataFrame([], "dt date"), "dt", "2001-08-01")
    assert empty == ["2001-08-01"]


def test_investor_months_are_read_from_one_row_an_account(spark):
    cols = "customer_id long, parent_id long, month date, status string, " + ", ".join(f"{m} double" for m in sub.INVESTOR_METRICS)
    D = dt.date
    long = spark.createDataFrame([
        (1, 9, D(2020, 1, 1), "Live", None, 0.0, 1.0, 2.0, 3.0), (1, 9, D(2020, 1, 17), "Backlog", 5.0, 0.0, 0.5, 4.0, 3.0),
        (1, 9, D(2021, 1, 1), "Churn", 1.0, 1.0, 1.0, 1.0, 1.0), (2, 9, D(2030, 1, 1), "Live", 1.0, 1.0, 1.0, 1.0, 1.0),
        (None, 9, D(2020, 2, 1), None, 7.0, None, None, None, None)], cols)
    wide = sub.investor_wide(long, ["2020-01-01", "2020-02-01", "2021-01-01"])
    assert wide.columns[:3] == ["customer_id", "2020_01_status", "2020_01_backlog_saas"] and len(wide.columns) == 19
    got = {r.customer_id: r.asDict() for r in wide.collect()}
    assert set(got) == {1, None}        # 2 has no month on the axis
    assert [got[1][f"2020_01_{c}"] for c in ("status", *sub.INVESTOR_METRICS)] == ["Live", 5.0, 0.0, 1.0, 4.0, 3.0]
    assert got[1]["2020_02_status"] is None and got[1]["2021_01_status"] == "Churn" and got[None]["2020_02_backlog_saas"] == 7.0
    # a month's columns are no aggregates of their own
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("max(") <= 6


def test_investor_payroll_is_computed_once(spark, tmp_path):
    from cohortix import catalog

    from .conftest import SF001
    t = catalog._t(spark, SF001)
    inputs = sub.InvestorInputs(catalog._loc(t), catalog.fx.accounts(t), catalog.fx.account_info(t), catalog._payroll(t), ("1998-01-01",))
    out = sub.investor_dataset(inputs, save=False, save_raw=True, stage=str(tmp_path / "long"))
    for name in ("payroll_account_info", "monthly_payroll_data", "payroll_long"):
        assert all(str(tmp_path) in f for f in out[name].inputFiles())
