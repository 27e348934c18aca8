"""Exact top-k by inner product on a pivot-distance index (operator 3).

Vectors x are extended by sqrt(M^2 - |x|^2), M the largest norm, and queries by
0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors are those of the
largest product, and distances to pivots bound it.

Index: each vector is keyed by its nearest pivot and its distance to it; a
pivot's distances are cut into rings.  A ring is stored in blocks of bounded
size, split by a hash of the vec_id, so a vector that fills a third of the table
is spread over many blocks.

Search: a block of queries takes its first threshold from one block of its own
pivot.  By the triangle inequality a ring [r0, r1] of pivot p holds no vector
nearer to q than the gap between d(q, p) and the ring.  Rings that cannot reach
the threshold of any query are dropped; the others are expanded from the
nearest on, in bounded slices, until the bound falls below the k-th score.
Bounds carry a slack for rounding; scores are integers and exact.

Pivots and ring edges are fitted on a bounded sample (``sample_rows`` rows of
smallest hash), every vector is indexed, and no candidate is dropped, so recall
is 1.  Only pivots, ring edges and ring statistics reach the driver: their
number is a parameter.

Edge cases: null vec_ids, null vectors, and vectors that hold null or
non-finite components take no part; shorter vectors are padded with zeros; rows
that repeat a vec_id are rows of their own (only the query's own row is no
candidate of it); scores that may not fit a long stop the job with an error; ties
go to the smaller vec_id; fewer than k candidates give all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import discard, with_columns_of, written

RING = "pivot int, ring int, split int, ids binary, rows binary, xs binary"
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(row_id, vec_id, v): floor(scale * x) of each component, as whole numbers.
    A row's number holds once the rows are written."""
    rows = with_columns_of(vectors, ["vec_id", "embedding"]).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    # exists() is null where only null components speak against a vector
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad)
    far = F.exists("e", lambda x: F.abs(x * scale) >= 2.0 ** 62)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "vec_id",
                       F.when(far, F.raise_error(F.lit("a component is too large for whole numbers"))).otherwise(
                           F.transform("e", lambda x: F.floor(x * scale).cast("bigint"))).alias("v"))


def _matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for k, v in enumerate(lists):
        out[k, :len(v)] = v
    return out


def _extended(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that gives all the same norm."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * x @ pivots.T
    return np.sqrt(np.maximum(sq, 0.0))


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Spread-out starting points (farthest first), moved to cluster means."""
    picked = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(picked) < min(count, len(sample)):
        k = int(near.argmax())
        if near[k] <= 0:
            break
        picked.append(k)
        near = np.minimum(near, _distances(sample, sample[k:k + 1])[:, 0])
    pivots = sample[picked]
    for _ in range(rounds):
        own = _distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[own == p].mean(axis=0) if (own == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores with their ids, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[at], ids[at]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while they stay below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0 ** 52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def top_k(vectors: DataFrame, k: int = 20, query_modulus: int = 20, scale: float = 64.0, pivots: int = 16,
          rings: int = 8, block_rows: int = 2048, query_rows: int = 256, sample_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = rows.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("top"),
                     F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if stats["dim"] is None:
        return spark.createDataFrame([], RESULT)
    dim, top = max(int(stats["dim"]), 1), float(stats["top"])
    if dim * (stats["most"] or 0) ** 2 >= 1 << 63:
        raise ValueError("inner products may not fit a long")
    drawn = rows.orderBy(F.xxhash64("row_id", "vec_id"), "row_id").limit(sample_rows).collect()
    sample = _extended(_matrix([r["v"] for r in drawn], dim), top)
    centres = choose_pivots(sample, pivots)
    d = _distances(sample, centres)
    own, edges = d.argmin(axis=1), []
    for p in range(len(centres)):
        r = d[own == p, p]
        edges.append(np.quantile(r, np.arange(1, rings) / rings) if len(r) else np.zeros(rings - 1))

    def assign(it):
        for pdf in it:
            if not len(pdf):
                continue
            x = _matrix(list(pdf["v"]), dim)
            dist = _distances(_extended(x, top), centres)
            near = dist.argmin(axis=1)
            r = dist[np.arange(len(x)), near]
            ring = [int(np.searchsorted(edges[p], v, side="right")) for p, v in zip(near, r)]
            yield pd.DataFrame({"row_id": pdf["row_id"], "vec_id": pdf["vec_id"], "pivot": near.astype(np.int32), "ring": np.array(ring, np.int32),
                                "dist": r, "x": [v.astype("<i8").tobytes() for v in x]})

    placed = written(rows.mapInPandas(assign, "row_id bigint, vec_id bigint, pivot int, ring int, dist double, x binary"), "placed")
    discard(rows)
    # a row per ring: pivots * rings at most
    ring_stats = placed.groupBy("pivot", "ring").agg(
        F.min("dist").alias("r0"), F.max("dist").alias("r1"), F.count("*").alias("n")).collect()
    ring_rows = [(r["pivot"], r["ring"], r["r0"], r["r1"], -(-r["n"] // block_rows)) for r in ring_stats]
    splits = F.broadcast(spark.createDataFrame([(p, g, s) for p, g, _, _, s in ring_rows], "pivot int, ring int, splits bigint"))
    blocks = sum(r[4] for r in ring_rows)
    slices = max(1, -(-blocks // 64))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row_id"])
        return pd.DataFrame({"pivot": pdf["pivot"].iloc[:1], "ring": pdf["ring"].iloc[:1], "split": pdf["split"].iloc[:1],
                             "ids": [pdf["vec_id"].to_numpy().astype("<i8").tobytes()],
                             "rows": [pdf["row_id"].to_numpy().astype("<i8").tobytes()], "xs": [b"".join(pdf["x"])]})

    index = placed.join(splits, ["pivot", "ring"]).withColumn(
        "split", F.pmod(F.xxhash64("row_id", F.lit("split")), "splits").cast("int"))
    index = written(index.groupBy("pivot", "ring", "split").applyInPandas(
        gather, RING), "pivot-index")

    queries = placed.filter(F.col("vec_id") % query_modulus == 0)
    query_counts = {r["pivot"]: r["n"] for r in queries.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    if not query_counts:
        return spark.createDataFrame([], RESULT)
    query_splits = F.broadcast(spark.createDataFrame(
        [(p, -(-n // query_rows)) for p, n in query_counts.items()], "pivot int, splits bigint"))
    query_blocks = queries.join(query_splits, "pivot").withColumn(
        "split", F.pmod(F.xxhash64("row_id", F.lit("query")), "splits").cast("int")).withColumn("ring", F.lit(0))
    query_blocks = query_blocks.groupBy("pivot", "split").applyInPandas(
        gather, RING).select(
        F.col("pivot").alias("qp"), F.col("split").alias("qs"), F.col("ids").alias("qids"), F.col("rows").alias("qrows"),
        F.col("xs").alias("qx"))

    def arrays(ids, xs):
        i = np.frombuffer(ids, "<i8")
        return i, np.frombuffer(xs, "<i8").reshape(len(i), dim)

    def upper(q: np.ndarray) -> np.ndarray:
        """Largest product that each query (row) can have in each ring (column)."""
        near = _distances(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]), centres)
        r0, r1 = np.array([r[2] for r in ring_rows]), np.array([r[3] for r in ring_rows])
        at = near[:, [r[0] for r in ring_rows]]
        gap = np.maximum(np.maximum(at - r1, r0 - at), 0.0)
        bound = ((q.astype(np.float64) ** 2).sum(axis=1)[:, None] + top - gap * gap) / 2.0
        return bound + 1e-6 * (1.0 + np.abs(bound))

    ring_at = {(r[0], r[1]): i for i, r in enumerate(ring_rows)}

    # one block of each pivot gives its queries a first threshold
    first = index.groupBy("pivot").agg(F.min(F.struct("ring", "split")).alias("f")).select(
        F.col("pivot").alias("qp"), F.col("f.ring").alias("ring"), F.col("f.split").alias("split"))
    seeds = index.select(F.col("pivot").alias("qp"), "ring", "split", "rows", "ids", "xs").join(first, ["qp", "ring", "split"]).select(
        "qp", "rows", "ids", "xs")

    def plan(it):
        for pdf in it:
            for qp, qs, qrows, qx, rows, xs in zip(pdf["qp"], pdf["qs"], pdf["qrows"], pdf["qx"], pdf["rows"], pdf["xs"]):
                qi, q = arrays(qrows, qx)
                floor = np.full(len(qi), -np.inf)
                if rows is not None:
                    xi, x = arrays(rows, xs)
                    for j, s in enumerate(_products(q, x)):
                        s = s[xi != qi[j]]
                        if len(s) >= k:
                            floor[j] = np.partition(s, len(s) - k)[len(s) - k]
                bound = upper(q)
                keep = np.flatnonzero((bound >= floor[:, None]).any(axis=0))
                yield pd.DataFrame({"qp": np.full(len(keep), qp, np.int32), "qs": np.full(len(keep), qs, np.int32),
                                    "pivot": np.array([ring_rows[i][0] for i in keep], np.int32),
                                    "ring": np.array([ring_rows[i][1] for i in keep], np.int32),
                                    "bound": bound[:, keep].max(axis=0)})

    query_blocks = written(query_blocks, "query-blocks")
    wanted = query_blocks.join(seeds, "qp", "left").mapInPandas(
        plan, "qp int, qs int, pivot int, ring int, bound double")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        qi, q = arrays(left["qids"].iloc[0], left["qx"].iloc[0])
        qr = np.frombuffer(left["qrows"].iloc[0], "<i8")
        bound = upper(q)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qi)
        floor = np.full(len(qi), -np.inf)
        for row in right.sort_values(["bound", "pivot", "ring", "split"], ascending=[False, True, True, True]).itertuples():
            reach = bound[:, ring_at[row.pivot, row.ring]]
            todo = np.flatnonzero(reach >= floor)
            if not len(todo):
                continue
            xi, x = arrays(row.ids, row.xs)
            xr = np.frombuffer(row.rows, "<i8")
            for j, s in zip(todo, _products(q[todo], x)):
                use = (xr != qr[j]) & (s >= floor[j])
                if use.any():
                    found[j] = best(np.concatenate([found[j][0], s[use]]), np.concatenate([found[j][1], xi[use]]), k)
                    if len(found[j][0]) == k:
                        floor[j] = found[j][0][-1]
        n = [len(f[0]) for f in found]
        return pd.DataFrame({"query_row": np.repeat(qr, n), "query_id": np.repeat(qi, n), "vec_id": np.concatenate([f[1] for f in found]),
                             "score": np.concatenate([f[0] for f in found])})

    work = wanted.join(index, ["pivot", "ring"]).withColumn(
        "slice", F.pmod(F.xxhash64("pivot", "ring", "split"), F.lit(slices)).cast("int"))
    asked = query_blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    partial = asked.groupBy("qp", "qs", "slice").cogroup(work.groupBy("qp", "qs", "slice")).applyInPandas(
        search, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
