"""Radix selection: order of the codes, exactness, bounded windows."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortix.operators.quantiles import STEP, exact_quantiles, merged_quantiles, order_key, quantile_sketches, rank_error


def bits(x):
    b = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return b if b >= 0 else -(b & 0x7FFFFFFFFFFFFFFF) - 1


def odd_doubles():
    rng = np.random.default_rng(1)
    out = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0 ** -1022, 2.0 ** -1023, 1.7976931348623157e308, float("inf"), -float("inf"), 0.1, 1e10]
    out += [math.nextafter(2.0 ** e, d) for e in range(-1022, 1024, 37) for d in (0.0, math.inf)] + [2.0 ** e for e in range(-1074, 1024, 13)]
    out += rng.integers(-2 ** 63, 2 ** 63 - 1, 3000, dtype=np.int64).view(np.float64).tolist()
    return [x for x in out if not math.isnan(x)]


def test_order_key_is_the_bits(spark):
    xs = odd_doubles()
    df = spark.createDataFrame([(float(x),) for x in xs] + [(float("nan"),)], "x double").select("x", order_key(F.col("x")).alias("k"))
    got = df.collect()
    for r in got[:-1]:
        assert r.k == bits(r.x), r.x
    assert got[-1].k == 2 ** 63 - 1


@pytest.mark.parametrize("method", ["linear", "midpoint"])
def test_equal_to_numpy_with_far_outliers(spark, method):
    rng = np.random.default_rng(4)
    groups = {"far": np.r_[np.arange(20000) / 7.0, 1e10, -1e300], "hot": np.r_[np.full(5000, 3.5), rng.normal(size=100)],
              "one": np.array([2.0]), "two": np.array([-1.0, 4.0]), None: rng.normal(size=51)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("nulls", None)], "g string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, method=method).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(np.quantile(vs, p, method=method), rel=1e-12), (g, n)


def test_equal_to_percentile_and_whole_table(spark):
    df = spark.range(30000).select((F.pmod(F.xxhash64("id"), F.lit(977)) - 300).alias("v"))
    q = exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.73}).first()
    want = df.agg(F.percentile("v", 0.1).alias("a"), F.percentile("v", 0.73).alias("b")).first()
    assert (q.a, q.b) == (want.a, want.b)
    big = spark.createDataFrame([(2 ** 62 + k,) for k in range(5)], "v bigint")       # beyond the doubles' precision
    assert big.agg(F.max("v")).first()[0] == 2 ** 62 + 4
    assert exact_quantiles(spark.createDataFrame([], "v double"), [], "v", {"a": 0.5}).first().a is None


def test_no_window_above_the_bound_with_one_far_outlier(spark):
    """A million distinct values up to 142,857 and one of 1e10: by equal widths all
    of them fell into one of 4096 buckets."""
    df = spark.range(1_000_000).select((F.col("id") / 7.0).alias("v")).unionByName(spark.createDataFrame([(1e10,)], "v double"))
    k = df.select(order_key(F.col("v")).alias("p0")).withColumn("p1", F.shiftright("p0", STEP)).withColumn("p2", F.shiftright("p1", STEP))
    r = k.groupBy("p2").agg(F.count_distinct("p1").alias("n1")).agg(F.max("n1"), F.count("*")).first()
    values = k.groupBy("p1").agg(F.count_distinct("p0").alias("n0")).agg(F.max("n0")).first()[0]
    assert max(r[0], r[1], values) < 25_000        # bound: 2 ** 21 for any data
    got = exact_quantiles(df, [], "v", {"m": 0.5, "top": 0.999}).first()
    assert got.m == pytest.approx(500_000 / 7.0) and got.top == pytest.approx(999_000 / 7.0)


def test_sketches_merge_without_the_rows(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("q"), F.col("id").cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(99, 0, None)], "k long, q long, v double")).repartition(6)
    quantile_sketches(df, ["k", "q"], "v", 512).write.parquet(str(tmp_path / "s"))
    saved = spark.read.parquet(str(tmp_path / "s"))
    assert saved.filter("k = 99").count() == 0 and saved.agg(F.sum("n")).first()[0] == 60_000
    assert saved.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    whole = merged_quantiles(saved, [], {"a": 0.1, "m": 0.5, "z": 0.99}, 512).first()
    for c, p in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
        assert abs(whole[c] / 60_000 - p) < 2 * rank_error(512)
    per = merged_quantiles(saved, ["q"], {"m": 0.5}, 512).collect()
    assert len(per) == 7 and all(abs(r.m / 60_000 - 0.5) < 2 * rank_error(512) for r in per)
    assert 0.012 < rank_error(200) < 0.02
