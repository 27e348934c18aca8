"""Operators on hand-sized frames (FIXTURES 3)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortix.operators.aggregates import conditional_distinct, value_counts, with_total
from cohortix.operators.joins import hierarchy, hour_split, latest_rows, natural_merge, period_offset
from cohortix.operators.stats import (corr_matrix, describe, exact_quantiles, iqr_flags, ols_by,
                                      t_sf_two_sided)
from cohortix.operators.windows import ffill, nearest_non_null


def d(y, m, day=1):
    return dt.date(y, m, day)


def test_period_offset_handles_gaps(spark):
    # two accounts, 14 months, one gap month: +12 lookup must not shift
    rows = [("a", d(2020, m if m <= 12 else m - 12, 1).replace(year=2020 if m <= 12 else 2021), float(m))
            for m in range(1, 15) if m != 2]
    rows += [("b", d(2020, 1), 5.0)]
    df = spark.createDataFrame(rows, "k string, month date, v double")
    out = {(r.k, r.month): r.v_12 for r in period_offset(df, ["k"], "month", ["v"]).collect()}
    assert out[("a", d(2020, 1))] == 13.0
    assert ("a", d(2020, 2)) not in out           # gap month: no current row
    assert out[("a", d(2020, 3))] == 0.0          # no row 12 months later -> 0
    assert out[("b", d(2020, 1))] == 0.0
    assert ("a", d(2021, 1)) in out                # rows only present in the future stay


def test_latest_rows_keep_ties(spark):
    df = spark.createDataFrame([(1, d(2020, 1), "x"), (1, d(2020, 3), "y"), (1, d(2020, 3), "w"), (1, d(2020, 3), "w"), (2, d(2020, 2), "z"),
                                (2, None, "n"), (None, d(2020, 1), "p"), (None, d(2020, 2), "q"), (3, None, "only")], "k int, dt date, s string")
    got = sorted(((r.k, r.s) for r in latest_rows(df, ["k"], "dt").collect()), key=str)
    assert got == sorted([(1, "w"), (1, "w"), (1, "y"), (2, "z"), (None, "q"), (3, "only")], key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_natural_merge_matches_null_keys(spark, how):
    left = [(k % 3 if k % 4 else None, "a" if k % 2 else None, k) for k in range(60)]
    right = [(0, "a", 1.0), (None, None, 2.0), (None, "a", 3.0), (1, None, 4.0), (None, None, 5.0), (9, "z", 6.0)]
    out = natural_merge(spark.createDataFrame(left, "k int, s string, v int"), spark.createDataFrame(right, "s2 int, s string, w double")
                        .withColumnRenamed("s2", "k"), how, salts=5)
    want = []
    for k, s, v in left:
        hits = [w for rk, rs, w in right if rk == k and rs == s]
        want += [(k, s, v, w) for w in hits] or ([(k, s, v, None)] if how == "left" else [])
    assert out.columns == ["k", "s", "v", "w"] and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_hour_split_cases(spark):
    ts = dt.datetime
    df = spark.createDataFrame([
        (1, ts(2024, 1, 1, 10, 5, 0, 500000), 600),     # inside one hour
        (2, ts(2024, 1, 1, 10, 50, 0), 1200),           # across one boundary
        (3, ts(2024, 1, 1, 10, 30, 0), 3 * 3600 + 60),  # across four boundaries
        (4, ts(2024, 1, 1, 10, 30, 0), 1800),           # ends exactly on the hour
    ], "id int, start_ts timestamp_ntz, seconds int")
    rows = hour_split(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r.seconds_in_hour)
    assert by[1] == [600]
    assert sorted(by[2]) == [600, 600]
    assert sum(by[3]) == 3 * 3600 + 60 and len(by[3]) == 4
    assert sorted(by[4]) == [0, 1800]


def test_nearest_non_null_and_ffill(spark):
    df = spark.createDataFrame([("c", m, v) for m, v in [(1, None), (2, "A"), (3, None), (4, "B"), (5, None)]],
                               "c string, m int, v string")
    got = [r.f for r in nearest_non_null(df, ["c"], "m", "v", "f").orderBy("m").collect()]
    assert got == ["A", "A", "A", "B", "B"]
    nums = spark.createDataFrame([("c", 1, None), ("c", 2, 3.0), ("c", 3, None)], "c string, m int, y double")
    assert [r.y for r in ffill(nums, ["c"], "m", "y").orderBy("m").collect()] == [0.0, 3.0, 3.0]


def test_conditional_distinct_and_total(spark):
    df = spark.createDataFrame([("m1", "a", 1), ("m1", "a", 5), ("m1", "b", 1), ("m1", None, 9)],
                               "g string, id string, v int")
    r = conditional_distinct(df, ["g"], "id", {"small": F.col("v") < 3, "big": F.col("v") > 3}).first()
    assert (r.small, r.big) == (2, 1)
    t = with_total(df.withColumn("line", F.col("id")).filter("id is not null"), ["g"], "line",
                   [F.count(F.lit(1)).alias("n")])
    got = {r.line: r.n for r in t.collect()}
    assert got == {"a": 2, "b": 1, "Total": 3}
    vc = {r.v: r.share for r in value_counts(df, "v").collect()}
    assert vc[1] == 0.5


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 40, 101).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").withColumn("g", F.lit(1))
    q = exact_quantiles(df, ["g"], "v", {"p25": 0.25, "p95": 0.95}).first()
    assert abs(q.p25 - np.percentile(vals, 25)) < 1e-9
    assert abs(q.p95 - np.percentile(vals, 95)) < 1e-9
    m = exact_quantiles(df, ["g"], "v", {"q1": 0.25}, method="midpoint").first()
    assert abs(m.q1 - np.percentile(vals, 25, method="midpoint")) < 1e-9
    q1, q3 = (np.percentile(vals, p, method="midpoint") for p in (25, 75))
    out = ((vals >= q3 + 0.2 * (q3 - q1)) | (vals <= q1 - 0.2 * (q3 - q1))).sum()
    assert iqr_flags(df, "v", k=0.2).filter("is_upper_outlier or is_lower_outlier").count() == out > 0


@pytest.mark.parametrize("conf", [{"spark.sql.exchange.reuse": "false"}, {"spark.sql.adaptive.enabled": "false"}, {}])
def test_exact_quantiles_do_not_depend_on_plan_reuse(spark, conf):
    before = {k: spark.conf.get(k) for k in conf}
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10 ** 6)) / 7.0).alias("v"))
    df = df.unionByName(df.select("g", (F.col("v") * 1e6).alias("v")).limit(1000)).repartition(7).cache()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        vals = np.array([r.v for r in df.select("v").collect()])
        got = exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.95}).first()
        for name, p in (("a", 25), ("b", 50), ("c", 95)):
            assert got[name] == pytest.approx(np.percentile(vals, p), rel=1e-12)
    finally:
        df.unpersist()
        for k, v in before.items():
            spark.conf.set(k, v)


def test_t_distribution_tail():
    # two-sided p for known t-table values
    p = t_sf_two_sided(np.array([2.228, 2.042, 1.96e9]), np.array([10, 30, 5]))
    assert abs(p[0] - 0.05) < 5e-4 and abs(p[1] - 0.05) < 5e-4 and p[2] < 1e-12


def test_ols_collinear_design_reports_rank(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        a, b = rng.normal(), rng.normal()
        rows.append((a, b, a + b, 1.0 + 2.0 * a - 1.0 * b + rng.normal() * 0.01))
    df = spark.createDataFrame(rows, "a double, b double, tot double, y double")
    res = {r.term: r for r in ols_by(df, "y", ["a", "b"]).collect()}
    assert abs(res["a"].coef - 2.0) < 0.01 and abs(res["const"].coef - 1.0) < 0.01
    assert res["a"].rank == 3 and res["a"].p_value < 1e-6
    col = ols_by(df, "y", ["a", "b", "tot"]).collect()
    assert col[0].rank == 3          # total = a + b is collinear
    x = np.column_stack([np.ones(200), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]])
    y = np.array([r[3] for r in rows])
    fitted = x @ np.array([{r.term: r.coef for r in col}[t] for t in ["const", "a", "b", "tot"]])
    assert np.allclose(fitted, x @ np.linalg.pinv(x) @ y, atol=1e-6)


def test_describe_and_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (4.0, 8.0)], "a double, b double")
    ds = {r.column: r for r in describe(df, ["a", "b"]).collect()}
    assert ds["a"].p25 == 1.75 and ds["a"]["count"] == 4
    c = corr_matrix(df, ["a", "b"]).first()
    assert c.r > 0.99


def test_hierarchy_two_levels(spark):
    ents = spark.createDataFrame([("loc1", "p1"), ("loc2", "p1"), ("p1", "g1"), ("g1", None)],
                                 "k string, parent string")
    got = {r.k: (r.parent_1, r.parent_2) for r in hierarchy(ents, "k", "parent").collect()}
    assert got["loc1"] == ("p1", "g1") and got["p1"] == ("g1", None)


def test_exact_quantiles_many_groups_across_partitions(spark):
    rng = np.random.default_rng(11)
    rows, ref = [], {}
    for g, n in (("a", 500), ("b", 37), ("c", 1)):
        vals = rng.normal(size=n).round(3)
        ref[g] = vals
        rows += [(g, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for g, vals in ref.items():
        for name, p in (("p10", 10), ("p50", 50), ("p99", 99)):
            assert abs(got[g][name] - np.percentile(vals, p)) < 1e-9


def test_ols_segments_equal_separate_fits(spark):
    from cohortix.operators.stats import ols_segments
    rng = np.random.default_rng(5)
    rows = [("young" if i % 3 == 0 else "old", float(a), float(b), float(1 + a - 2 * b + rng.normal()))
            for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "seg string, a double, b double, y double")
    one = {(r.segment, r.term): r.coef for r in ols_segments(df, "y", ["a", "b"], "seg", ["a"]).collect()}
    whole = {r.term: r.coef for r in ols_by(df, "y", ["a", "b"]).collect()}
    old = {r.term: r.coef for r in ols_by(df.filter("seg = 'old'"), "y", ["a"]).collect()}
    assert all(abs(one[("all", t)] - c) < 1e-9 for t, c in whole.items())
    assert all(abs(one[("old", t)] - c) < 1e-9 for t, c in old.items())
    assert ("old", "b") not in one


def test_ols_is_stable_under_another_origin(spark):
    rng = np.random.default_rng(9)
    age = rng.integers(0, 80, 3000).astype(float)
    rows = [(float(a), float(a * a), float(b), float(1 + 0.5 * a - 0.01 * a * a + 2 * b + e), "s" if a < 40 else "t")
            for a, b, e in zip(age, rng.normal(size=3000), rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "age double, age_sq double, b double, y double, seg string").repartition(5)
    far = df.withColumns({"age": F.col("age") + 1e6, "b": F.col("b") * 1e-3 - 1e4})
    one = {r.term: r for r in ols_by(df, "y", ["age", "age_sq", "b"]).collect()}
    two = {r.term: r for r in ols_by(far, "y", ["age", "age_sq", "b"]).collect()}
    for t, f in (("age", 1.0), ("age_sq", 1.0), ("b", 1e3)):
        assert two[t].coef == pytest.approx(one[t].coef * f, rel=1e-9)
        assert two[t].std_err == pytest.approx(one[t].std_err * f, rel=1e-7) and two[t].rank == 4
    x = np.column_stack([np.ones(3000), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]])
    y = np.array([r[3] for r in rows])
    beta, res, *_ = np.linalg.lstsq(x, y, rcond=None)
    cov = np.linalg.inv(x.T @ x) * res[0] / (3000 - 4)
    for k, t in enumerate(["const", "age", "age_sq", "b"]):
        assert one[t].coef == pytest.approx(beta[k], rel=1e-8) and one[t].std_err == pytest.approx(np.sqrt(cov[k, k]), rel=1e-8)
    assert one["b"].r2 == pytest.approx(1 - res[0] / ((y - y.mean()) ** 2).sum())


def test_ols_deficient_design_takes_the_smallest_solution(spark):
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=60) + 3, rng.normal(size=60) * 10
    y = 1 + a - b + rng.normal(size=60)
    df = spark.createDataFrame([(float(p), float(q), float(p + q), 5.0, float(r)) for p, q, r in zip(a, b, y)],
                               "a double, b double, tot double, five double, y double").repartition(3)
    got = {r.term: r for r in ols_by(df, "y", ["a", "b", "tot", "five"]).collect()}
    x = np.column_stack([np.ones(60), a, b, a + b, np.full(60, 5.0)])
    pinv = np.linalg.pinv(x)
    sigma = ((y - x @ pinv @ y) ** 2).sum() / (60 - 3)
    for k, t in enumerate(["const", "a", "b", "tot", "five"]):
        assert got[t].coef == pytest.approx((pinv @ y)[k], abs=1e-9) and got[t].rank == 3
        assert got[t].std_err == pytest.approx(np.sqrt(sigma * (pinv @ pinv.T)[k, k]), rel=1e-7)


def test_ols_odd_inputs(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 1.0), ("b", 1.0, 7.0), (None, 3.0, 6.0), ("a", float("nan"), 1.0)],
                               "seg string, x double, y double")
    got = {(r.segment, r.term): r for r in ols_by(df, "y", ["x"], by="seg").collect()}
    assert got[("a", "x")].coef == pytest.approx(2.0) and got[("a", "x")].n == 2
    assert got[("b", "x")].rank == 1 and {s for s, _ in got} == {"a", "b"}
    no_const = ols_by(df.filter("seg = 'a'"), "y", ["x"], add_const=False).collect()
    assert [r.term for r in no_const] == ["x"] and no_const[0].coef == pytest.approx(2.0)
    assert ols_by(df.filter("false"), "y", ["x"]).collect() == []
