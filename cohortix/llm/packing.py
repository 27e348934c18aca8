"""Bounded-space online packing (operator 9).

Each input partition is read once and keeps at most ``open_windows`` windows of
``window`` tokens.  A document's full windows leave at once; its tail goes to
the open window that it fills best.  When none fits, and no further window may
be opened, the fullest is emitted: a gap of at least ``min_cut`` tokens is
first filled with the head of the tail, a smaller one is padding.

The windows still open at the end of a partition are the leftovers.  They are
merged across partitions: laid end to end (by sums per partition, then per
window) and cut anew every ``window`` tokens.  What remains at the very end is
cut into powers of two, which need no padding.

Scale: no shuffle of texts or ids; only leftovers move, at most
``open_windows`` windows of a partition, and one row per partition is ordered
in one task.

Edge cases: null or empty text is its end id alone; null and repeated doc_ids
are packed row by row; a document longer than the window is cut; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import release_memory, with_columns_of, written
from .word_tokens import batch_ids

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "part int, win bigint, offset bigint, leftover boolean, ids binary")
LEFTOVER_BASE = 1 << 62


class OpenWindows:
    """Best fit over a bounded number of open windows.  ``place`` returns the
    pieces of a tail as (window key, offset, start, length); ``closed`` holds
    the keys of windows emitted since it was last read."""

    def __init__(self, window: int, limit: int, min_cut: int):
        self.window, self.limit, self.min_cut = window, limit, min_cut
        self.free: list[tuple[int, int]] = []     # (free tokens, key), sorted
        self.next_key = 0
        self.closed: list[int] = []

    def key(self) -> int:
        self.next_key += 1
        return self.next_key - 1

    def place(self, start: int, length: int) -> list[tuple[int, int, int, int]]:
        out = []
        while length:
            k = bisect.bisect_left(self.free, (length, -1))
            if k < len(self.free):
                gap, key = self.free.pop(k)
            elif len(self.free) < self.limit:
                gap, key = self.window, self.key()
            else:
                gap, key = self.free.pop(0)         # the fullest
                if gap < self.min_cut:
                    self.closed.append(key)
                    continue
            n = min(gap, length)
            out.append((key, self.window - gap, start, n))
            start, length = start + n, length - n
            if n < gap:
                bisect.insort(self.free, (gap - n, key))
            else:
                self.closed.append(key)
        return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = 4096, open_windows: int = 64,
         min_cut: int = 32, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; with ``with_ids`` also its ids (binary, uint32)."""

    def run(it):
        import pyarrow as pa
        from pyspark import TaskContext

        release_memory(("words", vocabulary))
        part = TaskContext.get().partitionId()
        windows = OpenWindows(window, open_windows, min_cut)
        held: dict[int, list] = {}       # key -> pieces of a window that is still open
        rows: list[tuple] = []

        def table(rows):
            cols = list(zip(*rows)) if rows else [[]] * 10
            types = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def piece(doc, start, body, total, key, offset, leftover):
            return (doc, start, len(body), zlib.crc32(body.tobytes()), total, part, key, offset, leftover,
                    body.tobytes() if leftover or with_ids else None)

        for b in it:
            names = b["doc_id"].to_pylist()
            for first, last, upto, ids in batch_ids(b["text"], vocabulary):
                for k in range(last - first):
                    body = np.append(ids[upto[k]:upto[k + 1]].astype("<u4"), np.uint32(end_id))
                    doc, total = names[first + k], len(body)
                    whole = total // window * window
                    for s in range(0, whole, window):
                        rows.append(piece(doc, s, body[s:s + window], total, windows.key(), 0, False))
                    for key, offset, s, n in windows.place(whole, total - whole):
                        held.setdefault(key, []).append((doc, s, body[s:s + n].copy(), total, key, offset))
                    for key in windows.closed:
                        rows += [piece(*p, False) for p in held.pop(key)]
                    windows.closed.clear()
                if len(rows) >= 4096:
                    yield table(rows)
                    rows = []
        for pieces in held.values():
            rows += [piece(*p, True) for p in pieces]
        yield table(rows)

    texts = with_columns_of(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = written(texts.mapInArrow(run, PIECES), "packed")
    ids = ["ids"] if with_ids else []
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids]
    closed = pieces.filter("not leftover").withColumn(
        "sequence_id", F.shiftleft(F.col("part").cast("bigint"), 40) + F.col("win")).select(*columns)
    return closed.unionByName(_merge_leftovers(pieces.filter("leftover"), window).select(*columns))


def _merge_leftovers(pieces: DataFrame, window: int) -> DataFrame:
    """Pieces of leftover windows, laid end to end and cut anew."""
    wins = pieces.groupBy("part", "win").agg(F.sum("length").alias("used"))
    parts = wins.groupBy("part").agg(F.sum("used").alias("used_part"))
    ordered = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("used_part").over(ordered), F.lit(0)).alias("before_part"))
    total = wins.agg(F.sum("used").alias("u")).first()["u"] or 0
    before = F.coalesce(F.sum("used").over(
        Window.partitionBy("part").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = wins.select("part", "win", before.alias("before_win")).join(parts, "part")
    at = pieces.join(wins, ["part", "win"]).withColumn("at", F.expr("before_part + before_win + offset"))
    at = at.withColumn("all_used", F.lit(total).cast("bigint"))
    # a piece is cut at each multiple of the window and, in the remainder, at
    # the binary digits of its length
    at = at.withColumn("tail_at", F.expr(f"all_used div {window} * {window}")).withColumn(
        "tail", F.expr("all_used - tail_at"))
    bits = (window - 1).bit_length()
    digits = F.expr(f"filter(transform(sequence(0, {bits - 1}), b -> shiftleft(1L, {bits - 1} - b)), v -> (tail & v) != 0)")
    at = at.withColumn("digits", digits)
    # start of the sequence that holds a position: the largest bound at or before it
    at = at.withColumn("seq_starts", F.expr(
        f"array_sort(array_distinct(concat(transform(sequence(at div {window}, (at + length - 1) div {window}), k -> k * {window}), "
        "transform(digits, v -> tail_at + (tail & (-2 * v))))))"))
    cut = at.select("*", F.expr(
        "filter(transform(seq_starts, (s, i) -> struct(s as s, coalesce(get(seq_starts, i + 1), 9223372036854775807L) as e)), "
        "x -> x.s < at + length and x.e > at)").alias("cuts")).withColumn("cut", F.explode("cuts"))
    cut = cut.withColumn("from", F.expr("greatest(cut.s, at) - at")).withColumn(
        "to", F.expr("least(cut.e, at + length) - at"))
    cut = cut.withColumn("body", F.expr("substring(ids, cast(4 * from + 1 as int), cast(4 * (to - from) as int))"))
    return cut.select(
        "doc_id", (F.col("start") + F.col("from")).alias("start"), F.expr("to - from").alias("length"),
        F.crc32("body").alias("ids_crc32"), "doc_tokens", F.expr(f"cut.s + {LEFTOVER_BASE}L").alias("sequence_id"),
        F.expr("at + from - cut.s").alias("offset"), F.col("body").alias("ids"))
