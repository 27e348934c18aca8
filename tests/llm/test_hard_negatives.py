import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortix.llm import hard_negatives as g

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, norm string"


def brute(rows, modulus, positives, negatives, scale=256):
    x = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            x.append((i, label, [math.floor(scale * float(np.float32(c))) for c in v]))
    out = []
    for n, (i, label, v) in enumerate(x):
        if i % modulus:
            continue
        s = [(-sum(a * b for a, b in zip(v, w)), j, lab) for m, (j, lab, w) in enumerate(x) if m != n]
        for p, j, _ in sorted(r for r in s if r[2] == label)[:positives]:
            fit = sorted(r for r in s if r[2] != label and 80 * -p <= 100 * -r[0] <= 100 * -p)
            out += [(i, j, k + 1, m, -p, -q) for k, (q, m, _) in enumerate(fit[:negatives])]
    return sorted(out)


def rows_of(kind):
    rng = np.random.default_rng(12)
    if kind == "spread":
        return [(k, rng.normal(size=10).tolist(), int(rng.integers(0, 4)), "s", "n") for k in range(500)]
    if kind == "norms":         # unlike norms: short rows have no postings
        return [(k, (rng.normal(size=10) * rng.choice([0.01, 1, 4])).tolist(), int(rng.integers(0, 3)), "s", "n") for k in range(400)]
    if kind == "hot":           # a third of the rows hold one vector, another third one label
        return [(k, ([0.5, 0.25, -0.125] if k % 3 == 0 else rng.normal(size=3).tolist()), 1 if k % 3 == 1 else k % 5, "s", "n")
                for k in range(300)]
    if kind == "far":           # no row of another label in any window, labels with one row
        return [(k, [1.0 + k % 2, 0.0], k % 2, "s", "n") for k in range(60)] + [(60, [-1.0, 0.0], 7, "s", "n")]
    return [(0, [1.0], 1, "s", "n"), (0, [1.0], 1, "s", "n"), (10, [1.0, 2.0], 1, "s", "n"), (10, [1.0, 2.0], 2, "s", "n"),
            (1, [1.0, 1.5], 2, "s", "n"), (1, [1.0, 1.5], 2, "s", "n"), (2, [], 2, "s", "n"), (20, [], 1, "s", "n"), (3, None, 1, "s", "n"),
            (4, [1.0], None, "s", "n"), (None, [1.0], 1, "s", "n"), (5, [None], 1, "s", "n"), (30, [float("nan")], 1, "s", "n"),
            (6, [float("inf")], 2, "s", "n"), (7, [-1.0, -1.0], 1, "s", "n"), (40, [0.9, 0.0], 2, "s", "n"), (8, [0.95], 2, "s", "n"),
            (-10, [1.0, 0.1], 1, "s", "n")]


@pytest.mark.parametrize("kind", ["spread", "norms", "hot", "far", "odd"])
def test_against_all_pairs(spark, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = g.mine(df, F.col("vec_id") % 10 == 0, positives=3, negatives=4, block_rows=16, query_rows=8, sample_rows=40,
                 sample_ranks=(1, 8), step=3)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 10, 3, 4)


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert g.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(10, [1.0], 1, "s", "n")], SCHEMA)
    assert g.mine(one, F.col("vec_id") % 10 == 0).collect() == []


def test_scores_beyond_a_long_stop(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9], 1, "s", "n"), (1, [1e9, 1e9], 1, "s", "n")], SCHEMA)
    with pytest.raises(ValueError, match="long"):
        g.mine(df, F.col("vec_id") == 0)


@pytest.mark.parametrize("cut", [-np.inf, 0.0, 150.0, 240.0])
@pytest.mark.parametrize("exact", [True, False])
def test_index_leaves_out_and_loses_nothing(cut, exact):
    rng = np.random.default_rng(3)
    x, q = rng.integers(-120, 120, (300, 12)), rng.integers(-120, 120, (40, 12))
    ids = np.arange(300)
    block = g.Block.build(ids, ids, ids, x, cut)
    low = cut * np.sqrt((q.astype(float) ** 2).sum(axis=1))
    got = {(a, int(block.row_ids[b]), int(s)) for a, b, s in zip(*g.reaching(q, low, block, exact, step=3))}
    full = q @ x.T
    assert got == {(a, b, int(full[a, b])) for a, b in zip(*np.nonzero(full >= low[:, None]))}
    if cut > 0:
        assert len(block.post_values) < x.size and block.left_out.max() > 0
    if cut == 240.0:
        assert block.n < 300


def many(spark, n, parts=16):
    component = [(F.pmod(F.xxhash64("id", F.lit(d)), F.lit(201)) - 100) / 100.0 for d in range(8)]
    return spark.range(n, numPartitions=parts).select(F.col("id").alias("vec_id"), F.array(*component).cast("array<float>").alias("embedding"),
                                                      F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("label"))


def miner_of(spark, n, sample_rows, query_rows=8):
    rows = g.written(g.usable(many(spark, n), 256.0), "mining-rows")
    return g.Miner(rows, rows.filter("vec_id % 10 = 0"), 3, 4, 80, 100, 16, query_rows, sample_rows, 8, 3)


def test_no_copies_and_no_broadcast_of_queries(spark):
    """Anchors reach every shard, but neither a copy per shard nor through the driver."""
    miner = miner_of(spark, 2000, 40)
    queries = miner.anchors.withColumn("low", F.lit(float("-inf"))).withColumn("windows", F.lit(None).cast(g.WINDOWS))
    plan = miner.join(queries)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "CartesianProduct" in plan
    asked = miner.asked(queries, 200)
    assert miner.shards == 8 and 20 < asked.count() <= 25      # blocks of 8 in expectation
    assert asked.rdd.getNumPartitions() == 1


def test_parts_of_queries_are_bounded(spark, monkeypatch):
    miner = miner_of(spark, 2000, 40)
    queries = miner.anchors.withColumn("low", F.lit(float("-inf"))).withColumn("windows", F.lit(None).cast(g.WINDOWS))
    whole = sorted(tuple(r) for r in miner.join(queries).collect())
    monkeypatch.setattr(g, "ASKED_BYTES", 4000)
    assert miner.asked(queries, 200).rdd.getNumPartitions() > 1
    assert sorted(tuple(r) for r in miner.join(queries).collect()) == whole


@pytest.mark.parametrize("n, size", [(4000, 30), (4000, 3999), (50, 60)])
def test_few_rows_enter_the_sample(spark, monkeypatch, n, size):
    """A top-k returns ``size`` rows from each task to the driver."""
    entered, sort = [], type(spark.range(1)).orderBy
    monkeypatch.setattr(type(spark.range(1)), "orderBy", lambda df, *by: (entered.append(df.count()), sort(df, *by))[1])
    miner = miner_of(spark, n, size)
    monkeypatch.undo()
    marked = sorted(tuple(r) for r in miner.rows.select(F.xxhash64("row_id", "vec_id"), "row_id").collect())
    assert miner.sample[0].tolist() == [r for _, r in marked[:size]]
    assert max(entered) <= max(4 * size, 200)
