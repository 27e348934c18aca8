"""Centroid clustering over subvector dictionaries (operator 11).

Lloyd's rounds in whole numbers.  The vectors are stored once, in chunks of
``chunk_rows`` rows.  A chunk cuts the dimensions into blocks and encodes each
block without loss: the distinct subvectors of the chunk's rows (the dictionary)
and a code per row.  A block starts ``widest`` dimensions wide and is halved
while its dictionary holds more than 1/``gain`` of the rows, so repeated vectors
share wide subvectors and unlike ones share single components.

A round computes, once per dictionary entry, its exact squared distance to each
centroid's part in that block; a row's distance is the sum over the blocks of the
entries its codes name.  The new centroids come from the dictionaries as well:
how often each cluster holds a code, times the subvector.

Scale: rounds are map-only passes over the chunk table.  A task returns one row
of sums per cluster whatever it read, and the driver holds k centroids.  No
vector is shuffled, nothing that grows with the data is broadcast, and a vector
or cluster that holds a third of all rows costs what others cost.  A chunk's
dictionaries are bounded by its rows.  The chunk table lies in the shared folder
(``_util.written``): a lost executor repeats its tasks only.

Edge cases: null vectors, vectors of another length, and vectors that hold null
or non-finite components take no part.  Components beyond ``LIMIT`` after scaling
stop the job with an error, as their distances fit no long.  Rows that repeat are
rows of their own.  A row without vec_id is assigned like any other, but is no
starting centroid.  Fewer than k vectors give as many centroids; an empty table
gives an empty result.  Equal starting hashes (a repeated vec_id) go in array
order.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import with_columns_of, written

LIMIT = 1 << 26     # of a component: squared distances of up to 511 dimensions fit a long

ASSIGNED = "vec_id bigint, cluster int, distance bigint"
CHUNK = ("ids array<bigint>, n int, blocks array<struct<start: int, width: int, entries: binary, codes: binary>>")


def kept(vectors: DataFrame, dim: int, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components of each whole vector."""
    rows = with_columns_of(vectors, ["vec_id", "embedding"]).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("e").isNotNull() & (F.size("e") == dim) & ~bad)
    far = F.exists("e", lambda x: F.abs(x * scale) > LIMIT)
    return rows.select("vec_id", F.when(far, F.raise_error(F.lit(f"a component times {scale:g} is beyond {LIMIT}")))
                       .otherwise(F.transform("e", lambda x: F.floor(x * scale).cast("int"))).alias("v"))


def start_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors of smallest sha256 of ``<seed>:<vec_id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picked = rows.filter("vec_id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in picked]


def encode_blocks(x: np.ndarray, widest: int, gain: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, code per row) for each block."""
    n, dim = x.shape
    out, todo = [], [(s, min(widest, dim - s)) for s in range(0, dim, widest)][::-1]
    while todo:
        start, width = todo.pop()
        part = np.ascontiguousarray(x[:, start:start + width])
        if width == 1:
            entries, codes = np.unique(part[:, 0], return_inverse=True)
            entries = entries[:, None]
        else:       # equal rows have equal bytes
            flat = part.view(np.dtype((np.void, part.dtype.itemsize * width)))[:, 0]
            entries, codes = np.unique(flat, return_inverse=True)
            if len(entries) * gain > n:
                todo += [(start + width // 2, width - width // 2), (start, width // 2)]
                continue
            entries = entries.view(part.dtype).reshape(-1, width)
        out.append((start, entries, codes))
    return out


def code_type(entries: int) -> str:
    return "<u1" if entries <= 1 << 8 else "<u2" if entries <= 1 << 16 else "<u4"


def chunks(rows: DataFrame, dim: int, chunk_rows: int, widest: int, gain: int) -> DataFrame:
    """The rows in dictionary-encoded chunks, where they lie."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], CHUNK).schema)

    def pack(ids, x):
        blocks = [{"start": s, "width": e.shape[1], "entries": e.astype("<i4").tobytes(),
                   "codes": c.astype(code_type(len(e))).tobytes()} for s, e, c in encode_blocks(x, widest, gain)]
        return pa.RecordBatch.from_pylist([{"ids": ids, "n": len(ids), "blocks": blocks}], schema=schema)

    def run(batches):
        ids, parts, held = [], [], 0
        for b in batches:
            v = b.column("v")
            x = np.asarray(v.flatten(), dtype=np.int32).reshape(-1, dim)
            own = b.column("vec_id").to_pylist()
            at = 0
            while at < len(own):
                take = min(chunk_rows - held, len(own) - at)
                ids += own[at:at + take]
                parts.append(x[at:at + take])
                held, at = held + take, at + take
                if held == chunk_rows:
                    yield pack(ids, np.concatenate(parts))
                    ids, parts, held = [], [], 0
        if held:
            yield pack(ids, np.concatenate(parts))

    return rows.mapInArrow(run, CHUNK)


def read_chunk(row: dict) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for b in row["blocks"]:
        entries = np.frombuffer(b["entries"], "<i4").reshape(-1, b["width"]).astype(np.int64)
        out.append((b["start"], entries, np.frombuffer(b["codes"], code_type(len(entries)))))
    return out


def nearest(blocks, n: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row: sums of dictionary distances."""
    total = np.zeros((n, len(centroids)), np.int64)
    for start, entries, codes in blocks:
        gap = entries[:, None, :] - centroids[None, :, start:start + entries.shape[1]]
        total += (gap * gap).sum(axis=2)[codes]
    own = total.argmin(axis=1)      # the first of equal ones: the smaller number
    return own, total[np.arange(n), own]


def cluster_sums(blocks, own: np.ndarray, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and component sums per cluster, by the use of each dictionary entry."""
    sums = np.zeros((k, dim), np.int64)
    for start, entries, codes in blocks:
        used = np.bincount(own * len(entries) + codes.astype(np.int64), minlength=k * len(entries)).reshape(k, -1)
        sums[:, start:start + entries.shape[1]] = used @ entries
    return np.bincount(own, minlength=k), sums


def one_round(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """New centroids: floor(sum / count) per component; empty clusters stay."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches):
        centres = np.array(centroids, np.int64)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for row in b.to_pylist():
                blocks = read_chunk(row)
                own, _ = nearest(blocks, row["n"], centres)
                c, s = cluster_sums(blocks, own, k, dim)
                counts, sums = counts + c, sums + s
        sums = np.hstack([sums, counts[:, None]])       # the last column counts rows
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(np.arange(k), dim + 1), pa.int32()),
            "at": pa.array(np.tile(np.arange(dim + 1), k), pa.int32()), "total": pa.array(sums.ravel(), pa.int64())})

    parts = table.mapInArrow(run, "cluster int, at int, total bigint")
    sums = np.zeros((k, dim + 1), object)       # exact whole numbers
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():   # k * (dim + 1) rows
        sums[r["cluster"], r["at"]] = r["total"]
    return [[s // row[dim] for s in row[:dim]] if row[dim] else old for row, old in zip(sums.tolist(), centroids)]


class Clustering:
    """Result of ``cluster``: the centroids (a list per cluster) and the
    assignment of every vector as a DataFrame."""

    def __init__(self, centroids: list[list[int]], assigned: DataFrame):
        self.centroids = centroids
        self.assigned = assigned


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, dim: int = 64,
            seed: str = "3", chunk_rows: int = 16384, widest: int = 8, gain: int = 4) -> Clustering:
    """Centroids after ``rounds`` rounds and (vec_id, cluster, distance) of each vector."""
    if dim * (2 * LIMIT) ** 2 >= 1 << 63:
        raise ValueError(f"squared distances of {dim} dimensions may not fit a long")
    spark = vectors.sparkSession
    rows = kept(vectors, dim, scale)
    centroids = start_centroids(rows, k, seed)
    table = written(chunks(rows, dim, chunk_rows, widest, gain), "vector-chunks")
    if not centroids:
        return Clustering([], spark.createDataFrame([], ASSIGNED))
    for _ in range(rounds):
        centroids = one_round(table, centroids)

    def assign(batches):
        centres = np.array(centroids, np.int64)
        for b in batches:
            for row in b.to_pylist():
                own, dist = nearest(read_chunk(row), row["n"], centres)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(own, pa.int32()),
                    "distance": pa.array(dist, pa.int64())})

    return Clustering(centroids, table.mapInArrow(assign, ASSIGNED))
