import numpy as np
import pytest

from cohortix.llm import pivot_search as g

SCHEMA = "vec_id bigint, embedding array<float>, score string, pivot string"


def brute(rows, k):
    seen = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v in seen), default=0)
    seen = [(i, np.array(v + [0] * (d - len(v)), np.int64)) for i, v in seen]
    out = []
    for n, (q, x) in enumerate(seen):
        if q % 20 == 0:
            best = sorted((-int(x @ v), i) for m, (i, v) in enumerate(seen) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def rows_of(kind):
    rng = np.random.default_rng(6)
    if kind == "clusters":
        centre = rng.normal(size=(5, 12))
        return [(k, (centre[k % 5] + 0.1 * rng.normal(size=12)).tolist(), "a", "b") for k in range(600)]
    if kind == "hot":       # a third of all rows hold one vector: ties by vec_id, blocks of bounded size
        return [(k, [0.5, 0.25, -0.125] if k % 3 == 0 else rng.normal(size=3).tolist(), "a", "b") for k in range(500)]
    if kind == "repeated":      # a third of the rows share one vec_id, some of them whole rows
        return [(40 if k % 3 == 0 else k, [0.5, 0.25] if k % 6 == 0 else rng.normal(size=2).tolist(), "a", "b") for k in range(240)]
    return [(1, [1.0], "a", "b"), (20, [1.0, 2.0], "a", "b"), (20, [1.0, 2.0], "a", "b"), (40, None, "a", "b"),
            (60, [float("nan")], "a", "b"), (None, [1.0], "a", "b"), (3, [None], "a", "b"), (80, [], "a", "b"),
            (5, [-1.0, 3.0], "a", "b"), (100, [float("inf")], "a", "b"), (120, [1.0, 1.0], "a", "b"), (120, [0.5, 9.0], "a", "b"),
            (-20, [-0.001, 0.0], "a", "b")]


@pytest.mark.parametrize("kind", ["clusters", "hot", "repeated", "odd"])
def test_against_all_pairs(spark, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA)
    out = g.top_k(df, k=7, pivots=4, rings=4, block_rows=32, query_rows=8, sample_rows=100)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 7)


def test_empty(spark):
    assert g.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ties_and_large_products():
    s, i = g.best(np.array([5, 7, 5, 5]), np.array([4, 9, 1, 2]), 3)
    assert s.tolist() == [7, 5, 5] and i.tolist() == [9, 1, 2]
    big = np.array([[1 << 30, 3]])
    assert g._products(big, big)[0, 0] == (1 << 60) + 9


def test_scores_beyond_a_long_stop(spark):
    df = spark.createDataFrame([(0, [3e9, 3e9], "a", "b"), (1, [3e9, 3e9], "a", "b")], SCHEMA)
    with pytest.raises(ValueError, match="long"):
        g.top_k(df)
