import hashlib
import math

import numpy as np
import pytest

from cohortix.llm import centroids as g

SCHEMA = "vec_id bigint, embedding array<float>, cluster int, distance string"


def brute(rows, k, rounds, dim, scale=1024):
    x = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, *_ in rows
         if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)
    centres = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, d.index(min(d)), min(d)))
        return out
    if not centres:
        return [], []
    for _ in range(rounds):
        own = [c for _, c, _ in assign()]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(x, own) if o == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return centres, assign()


def key(row):
    return tuple((v is None, v or 0) for v in row)


def rows_of(kind):
    rng = np.random.default_rng(11)
    if kind == "copies":        # a third holds one vector, half-equal vectors share blocks
        base = rng.normal(size=6)
        return [(k, (base if k % 3 == 0 else np.r_[base[:3], rng.normal(size=3)]).tolist(), 1, "d") for k in range(400)]
    if kind == "spread":
        return [(k, rng.normal(size=6).tolist(), 1, "d") for k in range(300)]
    if kind == "few":
        return [(1, [0.5] * 6, 1, "d"), (2, [-0.25] * 6, 1, "d")]
    return [(1, [0.5] * 6, 1, "d"), (1, [0.25] * 6, 1, "d"), (1, [0.5] * 6, 1, "d"), (2, None, 1, "d"), (3, [], 1, "d"), (4, [1.0] * 5, 1, "d"),
            (5, [float("nan")] * 6, 1, "d"), (6, [None] * 6, 1, "d"), (7, [0.1] * 5 + [float("inf")], 1, "d"),
            (None, [0.75] * 6, 1, "d"), (-8, [-0.0001] * 6, 1, "d"), (9, [1e-9] * 6, 1, "d"), (10, [0.5] * 6, 1, "d")]


@pytest.mark.parametrize("kind", ["copies", "spread", "few", "odd"])
def test_against_plain_rounds(spark, kind):
    rows = rows_of(kind)
    found = g.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=5, rounds=4, dim=6, chunk_rows=64, widest=4)
    centres, assigned = brute(rows, 5, 4, 6)
    assert found.centroids == centres
    assert sorted((tuple(r) for r in found.assigned.collect()), key=key) == sorted(assigned, key=key)


def test_empty(spark):
    found = g.cluster(spark.createDataFrame([], SCHEMA))
    assert found.centroids == [] and found.assigned.collect() == []


def test_component_beyond_the_limit_stops(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0], 1, "d")], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        g.cluster(df, dim=2)


def test_blocks_are_lossless_and_halved_only_where_unlike():
    rng = np.random.default_rng(2)
    x = rng.integers(-900, 900, size=(512, 16)).astype(np.int32)
    x[:, :8] = x[rng.integers(0, 5, 512), :8]       # five distinct subvectors
    blocks = g.encode_blocks(x, 8, 4)
    back = np.hstack([e[c] for _, e, c in sorted(blocks, key=lambda b: b[0])])
    assert (back == x).all()
    assert max(e.shape[1] for s, e, _ in blocks if s < 8) == 8 and len(blocks[0][1]) <= 5
    assert {e.shape[1] for s, e, _ in blocks if s >= 8} == {1}


def test_ties_go_to_the_smaller_number():
    x = np.array([[0], [4], [2]], np.int32)
    own, d = g.nearest(g.encode_blocks(x, 1, 4), 3, np.array([[4], [0], [0]]))
    assert own.tolist() == [1, 0, 0] and d.tolist() == [0, 0, 4]
