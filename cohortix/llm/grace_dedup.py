"""Exact deduplication by Grace hashing (operator 5).

Texts are equal when identical after lower-casing A-Z; null counts as empty.

1. Each input partition collapses its own copies in a bounded table, so a
   text that fills a third of the corpus leaves a partition as one row.
2. The rows are dealt out by the SHA-256 of the text (the first partitioning
   level; Spark's shuffle files are its spill files).
3. Each bucket streams into an open-addressing table that compares complete
   contents.  When the distinct contents outgrow the table's memory, table and
   rest of the stream are partitioned by the next byte of the hash into spill
   files, and each of those is done the same way, recursively.
4. Every document takes its group's result by the hash of its text.  This join
   moves no text; a hot hash on its left side is split by AQE's skew join.

Equal hashes with unequal contents would show in step 3 and stop the job
rather than merge texts.

Edge cases: an empty table gives an empty result; null and empty texts are one
group; a null doc_id is smaller than any other, so it stays only when all of
its group are null; rows that repeat a doc_id with the same text count as
members each, and ``dedup`` leaves one of them; other columns are ignored by
``dedup_groups`` and kept by ``dedup``.
"""

from __future__ import annotations

import pickle
import struct
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import ascii_lower, release_memory, with_columns_of

GROUP_SCHEMA = "sha binary, keep_id bigint, group_size bigint, keep_rows bigint"
COMBINED_SCHEMA = "sha binary, content binary, keep_id bigint, group_size bigint, keep_rows bigint"


class ContentTable:
    """Open addressing with linear probing.  A record is [hash, content,
    largest id, rows, rows with that id]; equal contents collapse."""

    def __init__(self, slots: int = 1024):
        self.clear(slots)

    def clear(self, slots: int = 1024) -> None:
        self.slots: list[int] = [-1] * slots
        self.records: list[list] = []
        self.bytes = 0

    @staticmethod
    def _home(sha: bytes, mask: int) -> int:
        return struct.unpack_from("<Q", sha, 24)[0] & mask

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        slots = [-1] * (mask + 1)
        for k, rec in enumerate(self.records):
            i = self._home(rec[0], mask)
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = k
        self.slots = slots

    def add(self, sha: bytes, content: bytes, keep, rows: int, keep_rows: int) -> None:
        mask = len(self.slots) - 1
        i = self._home(sha, mask)
        while (k := self.slots[i]) >= 0:
            rec = self.records[k]
            if rec[0] == sha:
                if rec[1] != content:
                    raise ValueError(f"two contents share the hash {sha.hex()}")
                rec[3] += rows
                if keep == rec[2]:
                    rec[4] += keep_rows
                elif rec[2] is None or (keep is not None and keep > rec[2]):
                    rec[2], rec[4] = keep, keep_rows
                return
            i = (i + 1) & mask
        self.slots[i] = len(self.records)
        self.records.append([sha, content, keep, rows, keep_rows])
        self.bytes += len(content) + 200
        if 3 * len(self.records) > 2 * len(self.slots):
            self._grow()


def grace(records: Iterable[tuple], budget: int, fan_out: int = 16, level: int = 0) -> Iterator[list]:
    """Distinct records of a stream, in memory of about ``budget`` bytes."""
    table, files, folder = ContentTable(), None, None
    try:
        for rec in records:
            if files is None:
                table.add(*rec)
                if table.bytes <= budget or level >= 24:
                    continue
                folder = tempfile.TemporaryDirectory(prefix="grace-")
                files = [open(f"{folder.name}/{k}", "w+b") for k in range(fan_out)]
                for old in table.records:
                    pickle.dump(tuple(old), files[old[0][level] % fan_out], protocol=5)
                table.clear()
            else:
                pickle.dump(tuple(rec), files[rec[0][level] % fan_out], protocol=5)
        if files is None:
            yield from table.records
            return
        for f in files:
            f.seek(0)
            yield from grace(_spilled(f), budget, fan_out, level + 1)
            f.truncate(0)
    finally:
        if folder is not None:
            for f in files or ():
                f.close()
            folder.cleanup()


def _spilled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def dedup_groups(docs: DataFrame, budget: int = 32 << 20) -> DataFrame:
    """(sha, keep_id, group_size, keep_rows) of every distinct normalised text."""
    import pyarrow as pa

    rows = with_columns_of(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.encode(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "UTF-8").alias("content"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("content", 256)))

    def batches(recs, names, types, size=256):
        out, held = [], 0
        for r in recs:
            out.append(r)
            held += len(r[1])
            if len(out) >= 4096 or held >= size << 15:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["sha", "content", "keep_id", "group_size", "keep_rows"]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def combine(it):
        release_memory()
        table = ContentTable()
        for b in it:
            for sha, content, doc in zip(b["sha"].to_pylist(), b["content"].to_pylist(), b["doc_id"].to_pylist()):
                table.add(sha, content, doc, 1, 1)
                if table.bytes > budget:
                    yield from batches(table.records, names, types)
                    table.clear()
        yield from batches(table.records, names, types)

    def bucket(it):
        def stream():
            for b in it:
                yield from zip(*(b[n].to_pylist() for n in names))
        slim = ((r[0], b"", r[2], r[3], r[4]) for r in grace(stream(), budget))
        for b in batches(slim, names, types):
            yield b.select([0, 2, 3, 4])

    combined = rows.mapInArrow(combine, COMBINED_SCHEMA)
    return combined.repartition("sha").mapInArrow(bucket, GROUP_SCHEMA)


def dedup_decisions(docs: DataFrame, budget: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = dedup_groups(docs, budget)
    members = with_columns_of(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)).alias("sha"))
    return members.join(groups, "sha").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(docs: DataFrame, budget: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Of rows that
    repeat both doc_id and text one stays."""
    spark_cols = docs.columns
    tag = "__dedup_"
    groups = dedup_groups(docs, budget).select(
        F.col("sha").alias(tag + "g"), F.col("keep_id").alias(tag + "keep"), F.col("keep_rows").alias(tag + "n"))
    texts = docs["text"] if "text" in spark_cols else F.lit(None)
    ids = docs["doc_id"].cast("bigint") if "doc_id" in spark_cols else F.lit(None).cast("bigint")
    keyed = docs.withColumn(tag + "sha", F.unhex(F.sha2(
        ascii_lower(F.coalesce(texts.cast("string"), F.lit(""))), 256))).withColumn(tag + "id", ids)
    # both keys: only the row that stays of a hot text leaves the scan's side of the join
    kept = keyed.join(groups, (F.col(tag + "sha") == F.col(tag + "g")) &
                      F.col(tag + "id").eqNullSafe(F.col(tag + "keep")))
    once = kept.filter(F.col(tag + "n") == 1)
    again = kept.filter(F.col(tag + "n") > 1).dropDuplicates([tag + "sha", tag + "id"])
    out = [F.col(f"`{c}`") for c in spark_cols]
    return once.select(*out).unionByName(again.select(*out))
