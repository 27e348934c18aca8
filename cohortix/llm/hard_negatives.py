"""Hard-negative mining by threshold joins on an inverted index (operator 12).

For each anchor: its best rows of the same label (the positives), and for each of
them the best rows of other labels whose score lies between ``low`` and ``high``
percent of the positive's score.  Scores are inner products of whole numbers.

Threshold join (after L2AP).  The dimensions are ordered by energy, the smallest
first.  Rows lie in blocks, each an inverted index: per dimension, the rows that
have a posting there and their values.  A row's leading dimensions are left out
of the index as far as their norm stays below the smallest threshold per unit of
query norm of the round: by Cauchy and Schwarz no pair reaches its threshold
through them alone.  A row whose whole norm stays below has no posting at all.
Postings are read from the last dimensions on, a few at a time, into partial
scores; a pair goes when the partial score and the product of the norms that
remain (of the dimensions not read, or left out) cannot reach the threshold.  For
the pairs that are left the score is completed exactly.

Thresholds start where a bounded sample of the rows (``sample_rows`` of smallest
hash) suggests that a window fills and are lowered from round to round for the
anchors whose windows are not full: for positives down to the sample's last
needed row of the label, then without any threshold; for negatives down to the
window's lower end.  The result is exact; the sample only decides the rounds.

Scale: anchors are a stated query set, compared in blocks with all rows.  Index
blocks lie in at most ``max_shards`` shards, blocks of about ``query_rows`` anchors
in parts of at most about ``ASKED_BYTES``; both are shuffled once a round and neither
is copied: a task reads one shard against one part (a Cartesian product, whatever
their sizes look like to the planner) and takes one pair of blocks at a time, so
memory is bounded by the block and part sizes.  A block returns at most
``positives`` (or ``negatives`` per window) rows for an anchor, so neither a label
nor a vector that a third of the rows holds multiplies anything.  Ranks are taken
over those rows with map-side limits.  What rounds have found lies in the shared
folder, a lost executor repeats its tasks only.  To the driver come counts,
maxima, energies per dimension and the sample, of which a task returns only rows
below a bound on the hash; joins by anchor are sort-merge joins, as written files are
several times smaller than the rows the planner would broadcast.

Edge cases: rows with a null vec_id, label or vector, or any null or non-finite
component take no part; shorter vectors are padded with zeros; rows that repeat
(a vec_id or a whole row) are rows of their own, and only the anchor's own row is
not its candidate; fewer candidates give all; a window of a negative positive
score is empty when ``low`` < ``high``; an empty table or one without anchors
gives an empty result; scores that times 100 would not fit a long stop the job
with an error; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import discard, with_columns_of, written

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
INDEX = ("shard int, row_ids binary, vec_ids binary, labels binary, left_out binary, starts binary, "
         "post_rows binary, post_values binary, rest binary")
ASKED = ("block int, row_ids binary, vec_ids binary, labels binary, x binary, low binary, window_low binary, "
         "window_score binary, window_id binary")
#: Of the anchors that a task holds while it reads a shard.
ASKED_BYTES = 16 << 20
FOUND = "row_id bigint, slot int, vec_id bigint, score bigint, anchor_id bigint, window_id bigint, window_score bigint"


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(row_id, vec_id, label, v, norm) of the rows that take part."""
    rows = with_columns_of(vectors, ["vec_id", "embedding", "label"]).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    far = F.exists("e", lambda x: F.abs(x * scale) >= 2.0 ** 62)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~bad)
    rows = rows.select("vec_id", "label", F.when(far, F.raise_error(F.lit("a component is too large for whole numbers")))
                       .otherwise(F.transform("e", lambda x: F.floor(x * scale).cast("bigint"))).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "*", F.sqrt(square).alias("norm"))


def matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for k, v in enumerate(lists):
        out[k, :len(v)] = v
    return out


def width(most: int) -> str:
    """The narrowest type that holds whole numbers up to ``most``."""
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def sample_of(rows: DataFrame, n: int, size: int) -> list:
    """The ``size`` rows of smallest hash, of ``n``.  Each task of a top-k returns up to
    ``size`` rows, so only rows below a bound on the hash enter it: about twice as many
    as needed from all tasks together."""
    mark, part = F.xxhash64("row_id", "vec_id"), 2 * size / n
    while True:
        near = rows.filter(mark < int((part - 0.5) * 2.0 ** 64)) if part < 1 else rows
        drawn = near.orderBy(mark, "row_id").limit(size).select("row_id", "label", "v").collect()
        if part >= 1 or len(drawn) == size:
            return drawn
        part *= 4


def prefix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of the first p components of each row, for p = 0 .. dim."""
    return np.sqrt(np.hstack([np.zeros((len(x), 1)), np.cumsum(x.astype(np.float64) ** 2, axis=1)]))


class Block:
    """An inverted index of some rows, and what it leaves out of them."""

    def __init__(self, row_ids, vec_ids, labels, left_out, starts, post_rows, post_values, rest):
        self.row_ids, self.vec_ids, self.labels, self.left_out = row_ids, vec_ids, labels, left_out
        self.starts, self.post_rows, self.post_values, self.rest = starts, post_rows, post_values, rest
        self.n, self.dim = len(row_ids), len(starts) - 1
        self._norms = self._postings = self._remaining = None

    @classmethod
    def build(cls, row_ids, vec_ids, labels, x: np.ndarray, cut: float) -> "Block":
        """``cut``: the smallest threshold per unit of query norm."""
        dim = x.shape[1]
        small = prefix_norms(x) < cut * (1 - 1e-9)
        left_out = np.maximum(small.sum(axis=1) - 1, 0)     # norms grow: the first ones are the small ones
        use = left_out < dim        # below the cut as a whole: no query of the round can reach such a row
        row_ids, vec_ids, labels, x, left_out = row_ids[use], vec_ids[use], labels[use], x[use], left_out[use]
        inside = np.arange(dim)[None, :] >= left_out[:, None]
        at, rows = np.nonzero(inside.T)
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=dim))])
        return cls(row_ids, vec_ids, labels, left_out, starts, rows, x[rows, at], x[~inside])

    def dense(self, first: int, last: int) -> np.ndarray:
        """Postings of some dimensions as a matrix, one row per row."""
        out = np.zeros((self.n, last - first), np.int64)
        s, e = self.starts[first], self.starts[last]
        dims = np.repeat(np.arange(first, last), np.diff(self.starts[first:last + 1]))
        out[self.post_rows[s:e], dims - first] = self.post_values[s:e]
        return out

    def remainder(self, at: int) -> np.ndarray:
        """What postings of the dimensions from ``at`` on do not hold."""
        out = np.zeros((self.n, self.dim), np.int64)
        out[:, :at] = self.dense(0, at)
        rows = np.repeat(np.arange(self.n), self.left_out)
        before = np.cumsum(self.left_out) - self.left_out
        out[rows, np.arange(len(rows)) - np.repeat(before, self.left_out)] = self.rest
        return out

    def norms(self) -> np.ndarray:
        if self._norms is None:
            self._norms = prefix_norms(self.remainder(self.dim))
        return self._norms

    def postings(self, kind) -> np.ndarray:
        if self._postings is None or self._postings.dtype != kind:
            self._postings = self.dense(0, self.dim).astype(kind)
        return self._postings

    def remaining(self, at: int, kind) -> np.ndarray:
        """``remainder`` without the dimensions that are zero in every row."""
        if self._remaining is None or self._remaining[0] != (at, kind):
            end = max(at, int(self.left_out.max(initial=0)))
            self._remaining = (at, kind), np.ascontiguousarray(self.remainder(at)[:, :end]).astype(kind)
        return self._remaining[1]


def reaching(q: np.ndarray, low: np.ndarray, block: Block, exact_floats: bool, step: int = 8,
             sparse: float = 1 / 16, strip: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs whose score reaches the query's threshold.
    Queries go in strips, whose partial scores fit a core's cache.  The first strip looks
    after every ``step`` dimensions how many pairs are left; the others first read as many
    dimensions as it took until few were left."""
    kind = np.float64 if exact_floats else np.int64
    q = q.astype(kind)
    q_norms, x_norms, x = prefix_norms(q), block.norms(), block.postings(kind)
    enough = low - 1e-9 * q_norms[:, -1] * x_norms[:, -1].max(initial=0.0) - 1e-6      # bounds are floats
    rows, far, found = np.arange(block.n), max(0, block.dim - step), []
    for s in range(0, max(len(q), 1), strip):
        own, norms, least = q[s:s + strip], q_norms[s:s + strip], enough[s:s + strip, None]
        at, first, partial = block.dim, far, np.zeros((len(own), block.n), kind)
        while True:
            partial += own[:, first:at] @ x[:, first:at].T
            at, first = first, max(0, first - step)
            ends = np.maximum(block.left_out, at)
            bound = norms.take(ends, axis=1)
            bound *= x_norms[rows, ends]
            bound += partial
            alive = bound >= least
            few = np.count_nonzero(alive) < sparse * alive.size
            if few or at == 0:
                break
        far = at if s == 0 else far
        rest = block.remaining(at, kind)
        if few:
            qi, xi = np.nonzero(alive)
            score = partial[qi, xi]
            for k in range(0, len(qi), 1 << 16):        # bounded: some pairs at a time
                pairs = slice(k, k + (1 << 16))
                score[pairs] += np.einsum("ij,ij->i", own[qi[pairs], :rest.shape[1]], rest[xi[pairs]])
        else:
            partial += own[:, :rest.shape[1]] @ rest.T
            qi, xi = np.nonzero(alive)
            score = partial[qi, xi]
        score = score.astype(np.int64)
        use = score >= low[s:s + strip][qi]
        found.append((qi[use] + s, xi[use], score[use]))
    return tuple(np.concatenate(c) for c in zip(*found))


def first_of_each(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first rows of each group: higher scores first, ties by smaller vec_id."""
    order = np.lexsort((vec_id, -score, group))
    g = group[order]
    begin = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1]) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(g)]])))
    return order[rank < k]


class Miner:
    """The parameters of one job, its row table and its facts."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int,
                 block_rows: int, query_rows: int, sample_rows: int, max_shards: int, step: int):
        self.rows, self.anchors, self.made = rows, anchors, [rows]
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high
        self.block_rows, self.query_rows, self.step = block_rows, query_rows, step
        facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"),
                         F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
        self.n, self.dim, most = facts["n"], max(facts["dim"] or 0, 1), facts["most"] or 0
        if self.dim * most * most * 100 >= 1 << 63:
            raise ValueError("inner products times 100 may not fit a long")
        self.exact_floats = self.dim * most * most < 1 << 52
        self.value, self.place = width(most), width(block_rows)
        self.shards = max(1, min(max_shards, self.n // (2 * block_rows)))
        square = (F.col("x").cast("double") * F.col("x").cast("double"))
        energy = np.zeros(self.dim)
        for r in rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(square).alias("s")).collect():
            energy[r["d"]] = r["s"]         # a row per dimension
        self.order = np.argsort(energy, kind="stable")
        drawn = sample_of(rows, self.n, sample_rows)
        self.sample = (np.array([r["row_id"] for r in drawn], np.int64), np.array([r["label"] for r in drawn], np.int64),
                       matrix([r["v"] for r in drawn], self.dim))

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(written(df, tag))
        return self.made[-1]

    def thresholds(self, ranks: tuple[int, ...]) -> DataFrame:
        """row_id, lows: falling thresholds of each anchor, from its scores in the
        sample: those of some ranks, then that of the last needed row of its label."""
        ids, labels, x = self.sample
        dim, need = self.dim, self.positives

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                scores = matrix(list(pdf["v"]), dim).astype(np.float64) @ x.T.astype(np.float64)
                out = []
                for row, label, s in zip(pdf["row_id"], pdf["label"], scores):
                    other = ids != row
                    every, same = np.sort(s[other])[::-1], np.sort(s[other & (labels == label)])[::-1]
                    last = same[need - 1] if len(same) >= need else -np.inf
                    lows = [every[k - 1] if len(every) >= k else -np.inf for k in ranks]
                    # a hair lower: the sample's scores are floats
                    out.append([max(t, last) - 1e-6 * abs(t) if np.isfinite(t) else last for t in lows]
                               + [last - 1e-6 * abs(last) if np.isfinite(last) else last, -np.inf])
                yield pd.DataFrame({"row_id": pdf["row_id"], "lows": out})

        return self.anchors.select("row_id", "label", "v").mapInPandas(run, "row_id bigint, lows array<double>")

    def index(self, cut: float) -> DataFrame:
        order, dim, size, shards, value, place = self.order, self.dim, self.block_rows, self.shards, self.value, self.place

        def pack(parts):
            pdf = pd.concat(parts)
            b = Block.build(pdf["row_id"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64),
                            matrix(list(pdf["v"]), dim)[:, order], cut)
            if not b.n:
                return None
            shard = (int(b.row_ids[0]) * 2654435761 >> 16) % shards
            return pd.DataFrame({
                "shard": np.array([shard], np.int32), "row_ids": [b.row_ids.tobytes()],
                "vec_ids": [b.vec_ids.tobytes()], "labels": [b.labels.tobytes()], "left_out": [b.left_out.astype("<i4").tobytes()],
                "starts": [b.starts.astype("<i8").tobytes()], "post_rows": [b.post_rows.astype(place).tobytes()],
                "post_values": [b.post_values.astype(value).tobytes()], "rest": [b.rest.astype(value).tobytes()]})

        def run(batches):
            parts, held = [], 0
            for pdf in batches:
                while len(pdf):
                    parts.append(pdf[:size - held])
                    held, pdf = held + len(parts[-1]), pdf[size - held:]
                    if held == size:
                        out = pack(parts)
                        parts, held = [], 0
                        if out is not None:
                            yield out
            if held and (out := pack(parts)) is not None:
                yield out

        return self.rows.select("row_id", "vec_id", "label", "v").mapInPandas(run, INDEX)

    def asked(self, queries: DataFrame, count: int) -> DataFrame:
        """Queries (row_id, vec_id, label, v, low, windows) in blocks, a few to a partition."""
        order, dim, slots, value = self.order, self.dim, self.positives, self.value

        def gather(pdf: pd.DataFrame) -> pd.DataFrame:
            low, score, ident = (np.full((len(pdf), slots), f, t) for f, t in ((np.inf, "<f8"), (0, "<i8"), (0, "<i8")))
            for k, ws in enumerate(pdf["windows"]):
                for w in ws if ws is not None else ():
                    low[k, w["slot"]], score[k, w["slot"]], ident[k, w["slot"]] = w["low"], w["score"], w["vec_id"]
            return pd.DataFrame({
                "block": pdf["block"].iloc[:1], "row_ids": [pdf["row_id"].to_numpy(np.int64).tobytes()],
                "vec_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "labels": [pdf["label"].to_numpy(np.int64).tobytes()],
                "x": [matrix(list(pdf["v"]), dim)[:, order].astype(value).tobytes()], "low": [pdf["low"].to_numpy(np.float64).tobytes()],
                "window_low": [low.tobytes()], "window_score": [score.tobytes()], "window_id": [ident.tobytes()]})

        blocks = -(-count // self.query_rows)
        put = queries.select("row_id", "vec_id", "label", "v", "low", "windows",
                             F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("block"))
        size = np.dtype(value).itemsize * dim + 32 + 24 * slots
        parts = max(1, min(blocks, -(-count * size // ASKED_BYTES)))
        return put.groupBy("block").applyInPandas(gather, ASKED).repartitionById(parts, F.pmod("block", F.lit(parts)))

    def join(self, queries: DataFrame) -> DataFrame:
        """FOUND rows: for each query the best rows of each block that reach its
        thresholds; without windows those of its label, else of other labels."""
        unit = F.when(F.col("norm") > 0, F.col("low") / F.col("norm")).when(F.col("low") <= 0, F.lit(float("-inf")))
        facts = queries.agg(F.count("*").alias("n"), F.min(unit).alias("cut")).first()
        spark = queries.sparkSession
        if not facts["n"]:
            return spark.createDataFrame([], FOUND)
        cut = facts["cut"] if facts["cut"] is not None else float("inf")
        dim, value, place, slots, exact, step = self.dim, self.value, self.place, self.positives, self.exact_floats, self.step
        keep, low, high = (self.positives, self.negatives), self.low, self.high

        def run(batches):
            for b in batches:
                block = None
                for k in range(b.num_rows):     # views of the batch, no copies
                    r = {c: b.column(c)[k].as_buffer() for c in b.schema.names if c not in ("shard", "block")}
                    ints = {c: np.frombuffer(r[c], "<i8") for c in ("row_ids", "vec_ids", "labels", "a_row_ids", "a_vec_ids", "a_labels")}
                    if block is None or block.row_ids[0] != ints["row_ids"][0]:     # the pairs of an index block follow each other
                        block = Block(ints["row_ids"], ints["vec_ids"], ints["labels"],
                                      np.frombuffer(r["left_out"], "<i4").astype(np.int64), np.frombuffer(r["starts"], "<i8"),
                                      np.frombuffer(r["post_rows"], place), np.frombuffer(r["post_values"], value), np.frombuffer(r["rest"], value))
                    q = np.frombuffer(r["x"], value).reshape(-1, dim)
                    qi, xi, score = reaching(q, np.frombuffer(r["low"], "<f8"), block, exact, step)
                    same = ints["a_labels"][qi] == ints["labels"][xi]
                    window_low = np.frombuffer(r["window_low"], "<f8").reshape(-1, slots)
                    hits = []       # (slot, places among the pairs)
                    if np.isinf(window_low).all():
                        at = np.flatnonzero(same & (ints["a_row_ids"][qi] != ints["row_ids"][xi]))
                        hits.append((0, at[first_of_each(qi[at], score[at], ints["vec_ids"][xi[at]], keep[0])]))
                    window_score = np.frombuffer(r["window_score"], "<i8").reshape(-1, slots)
                    window_id = np.frombuffer(r["window_id"], "<i8").reshape(-1, slots)
                    for slot in np.flatnonzero(np.isfinite(window_low).any(axis=0)):
                        own = window_score[qi, slot]
                        at = np.flatnonzero(~same & (score >= window_low[qi, slot]) & (100 * score >= low * own) & (100 * score <= high * own))
                        hits.append((slot, at[first_of_each(qi[at], score[at], ints["vec_ids"][xi[at]], keep[1])]))
                    for slot, at in hits:
                        if len(at):
                            a = qi[at]
                            yield pa.RecordBatch.from_pydict({
                                "row_id": ints["a_row_ids"][a], "slot": np.full(len(at), slot, np.int32),
                                "vec_id": ints["vec_ids"][xi[at]], "score": score[at], "anchor_id": ints["a_vec_ids"][a],
                                "window_id": window_id[a, slot], "window_score": window_score[a, slot]})

        asked = self.asked(queries, facts["n"])
        asked = asked.withColumnsRenamed({c: f"a_{c}" for c in ("row_ids", "vec_ids", "labels")})
        index = self.index(cut).repartitionById(self.shards, F.col("shard"))
        return index.crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(run, FOUND)

    def best_positives(self, ranks: tuple[int, ...]) -> DataFrame:
        """row_id, slot, vec_id, score, anchor_id of each anchor's positives."""
        others = self.rows.groupBy("label").agg((F.count("*") - 1).alias("others"))
        need = self.anchors.join(others, "label").withColumn("need", F.least("others", F.lit(self.positives))).filter("need > 0")
        pending = self.write(need.join(self.thresholds(ranks), "row_id"), "mining-anchors")
        everyone, kept = pending, []
        rank = Window.partitionBy("row_id").orderBy(F.desc("score"), "vec_id")
        for level in range(len(ranks) + 2):
            queries = pending.withColumn("low", F.col("lows")[level]).withColumn("windows", F.lit(None).cast(WINDOWS))
            found = self.join(queries).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= self.positives)
            found = self.write(found.withColumn("slot", F.col("rank") - 1), "mining-positives")
            have = found.groupBy("row_id").agg(F.count("*").alias("have"))
            full = pending.select("row_id", "need").join(have.hint("merge"), "row_id").filter("have >= need").select("row_id").hint("merge")
            kept.append(found.join(full, "row_id", "left_semi"))
            pending = self.write(pending.join(full, "row_id", "left_anti"), "mining-anchors")
            if pending.isEmpty():
                break
        out = kept[0]
        for k in kept[1:]:
            out = out.unionByName(k)
        out = self.write(out.select("row_id", "slot", "vec_id", "score"), "mining-windows")
        self.everyone = everyone
        return out

    def negatives_of(self, windows: DataFrame, steps: tuple[float, ...]) -> DataFrame:
        """The best rows of each window, its lower end reached in ``steps``."""
        bottom = F.col("score") * (self.low / 100)
        rank = Window.partitionBy("row_id", "slot").orderBy(F.desc("score"), "vec_id")
        # a window that no score fits: low percent of a negative score lie above high percent
        pending, out = windows.filter(F.col("score") * self.low <= F.col("score") * self.high), None
        for k, part in enumerate(steps):
            top = F.col("score") * (self.high / 100)
            low = bottom + (top - bottom) * part
            low = low - F.abs(low) * 1e-9 - 1e-6
            per = pending.withColumn("low", low).groupBy("row_id").agg(
                F.min("low").alias("low"), F.collect_list(F.struct("slot", "vec_id", "score", "low")).alias("windows"))
            queries = self.everyone.select("row_id", "vec_id", "label", "v", "norm").join(per.hint("merge"), "row_id")
            found = self.join(queries).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= self.negatives)
            found = self.write(found, "mining-negatives")
            if k == len(steps) - 1:
                return found if out is None else out.unionByName(found)
            full = found.groupBy("row_id", "slot").agg(F.count("*").alias("have")).filter(F.col("have") >= self.negatives).hint("merge")
            done = found.join(full.select("row_id", "slot"), ["row_id", "slot"], "left_semi")
            out = done if out is None else out.unionByName(done)
            pending = self.write(pending.join(full, ["row_id", "slot"], "left_anti"), "mining-windows")
            if pending.isEmpty():
                return out
        return out


WINDOWS = "array<struct<slot: int, vec_id: bigint, score: bigint, low: double>>"


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: float = 256.0, block_rows: int = 2048, query_rows: int = 1024, sample_rows: int = 2048,
         max_shards: int = 1024, sample_ranks: tuple[int, ...] = (4, 32), window_steps: tuple[float, ...] = (0.5, 0.0),
         step: int = 8) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: a condition on vec_id and label.  ``sample_ranks``: whose scores
    in the sample are the first thresholds.  ``window_steps``: parts of a window, as
    thresholds of its rounds; the last must be 0, its lower end."""
    if window_steps[-1] != 0:
        raise ValueError("the last window step must be 0")
    rows = written(usable(vectors, scale), "mining-rows")
    anchors = rows.filter(is_anchor)
    if anchors.isEmpty():
        return vectors.sparkSession.createDataFrame([], RESULT)
    miner = Miner(rows, anchors, positives, negatives, low, high, block_rows, query_rows, sample_rows, max_shards, step)
    found = miner.negatives_of(miner.best_positives(sample_ranks), window_steps)
    result = written(found.select("anchor_id", F.col("window_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                  F.col("vec_id").alias("negative_id"), F.col("window_score").alias("positive_score"),
                                  F.col("score").alias("negative_score")), "mining-result")
    discard(*miner.made)
    return result
