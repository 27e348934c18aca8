"""Tokenised documents in files of directly addressable codes (operator 2).

``write_token_files`` encodes every text, appends an end id, and writes the
documents in ascending doc_id order as files of ``dac``'s format into one
folder of a store that the executors reach (spark.checkpoint.dir by default).
The manifest (one row per file, a table written by Spark) names the files that
count: a task that ran twice leaves a file that no manifest row names.
``read_token_files`` reads them with Spark's binary reader.

Scale: one shuffle by doc_id range moves the texts; a task holds one batch of
texts and one file's ids.  Starts come from sums per partition and per file.

Edge cases: null text is empty (its end id remains); null doc_ids come first;
equal doc_ids are ordered by a hash of their text, and identical rows are both
kept; an empty table gives no file and an empty result; texts of any length
are encoded whole, a document longer than a file gets a file for itself.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import scratch, with_columns_of, written
from .dac import Reader
from .dac import encode as encode_dac
from .word_tokens import batch_ids

MANIFEST_SCHEMA = "part int, seq int, file string, n_docs bigint, n_tokens bigint"
READ_SCHEMA = "file string, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def _documents(docs: DataFrame) -> DataFrame:
    return with_columns_of(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, file_tokens: int = 4_000_000,
                      folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the files; returns (folder, manifest)."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")

    def write(it):
        import pyarrow as pa
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        store, root = pafs.FileSystem.from_uri(folder)
        doc_ids, lengths, chunks, held, seq = [], [], [], 0, 0

        def flush():
            nonlocal doc_ids, lengths, chunks, held, seq
            name = f"part-{part:07d}-{seq:05d}-{attempt}.dac"
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
            body = encode_dac(doc_ids, offsets, np.concatenate(chunks))
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(body)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name],
                "n_docs": [len(doc_ids)], "n_tokens": [int(offsets[-1])]})
            doc_ids, lengths, chunks, held, seq = [], [], [], 0, seq + 1
            return row

        for b in it:
            names = b["doc_id"].to_pylist()
            for first, last, upto, ids in batch_ids(b["text"], vocabulary):
                n = np.diff(upto)
                # the end id after each document
                joined = np.insert(ids.astype(np.uint32), upto[1:], end_id)
                cut = np.concatenate([[0], np.cumsum(n + 1)])
                k = 0
                while k < last - first:
                    # as many documents as fill the file, one at least
                    j = int(np.searchsorted(cut, cut[k] + max(file_tokens - held, 1), side="right")) - 1
                    j = min(max(j, k + 1), last - first)
                    doc_ids += names[first + k:first + j]
                    lengths += (n[k:j] + 1).tolist()
                    chunks.append(joined[cut[k]:cut[j]])
                    held += int(cut[j] - cut[k])
                    k = j
                    if held >= file_tokens:
                        yield flush()
        if doc_ids:
            yield flush()

    ordered = _documents(docs).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return folder, written(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST_SCHEMA), "token-manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """(file, start): ids of all files before it.  Sums per part first, so the
    one ordered pass sees a row per part."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.select("part", "file", within.alias("within")).join(before, "part").select(
        "file", (F.col("before") + F.col("within")).alias("file_start"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def read(it):
        import pyarrow as pa
        for b in it:
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                r = Reader(content.as_buffer())
                ids = r.all().astype("<u4")
                at = r.offsets
                yield pa.RecordBatch.from_pydict({
                    "file": [path.rsplit("/", 1)[-1]] * len(r.doc_ids), "doc_id": pa.array(r.doc_ids, pa.int64()),
                    "local_start": pa.array(at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:z].tobytes()) for a, z in zip(at[:-1], at[1:])], pa.int64())})

    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    rows = files.select("path", "content").mapInArrow(read, READ_SCHEMA)
    return rows.join(file_starts(manifest), "file").select(
        "doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
