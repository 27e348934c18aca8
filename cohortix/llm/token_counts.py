"""Token counts by whole-token shortcut (operator 10).

Offline, each vocabulary string is encoded alone; those that give one token are
the whole tokens.  A segment of a text (see ``piece_model``) that is a whole
token counts one without any merging; only the others go to the library, each
distinct one once per worker.

Scale: one pass, no shuffle.  A worker's cache of segments is bounded.

Edge cases: null text is empty and has no token; a text with a NUL character,
and any text under a model that cannot be cut, is encoded whole by the library;
null, repeated and clashing columns pass row by row; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import with_columns_of, worker_cache
from .piece_model import NORMAL, Cutter, parse
from .segments import BREAK, RaggedCache, as_large, factorize

COUNT_SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


class Counter:
    """Token counts of batches of texts, as the library gives them."""

    def __init__(self, path: str):
        import sentencepiece as spm

        proto = parse(path)
        self.cutter = Cutter(proto)
        self.library = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        proto.normalizer_spec.add_dummy_prefix = False
        self.inner = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        strings = [p.piece for p in proto.pieces if p.type == NORMAL]
        alone = self.inner.encode(strings, num_threads=1)
        self.whole_tokens = pa.array([s for s, ids in zip(strings, alone) if len(ids) == 1], pa.large_string())
        self.rest = RaggedCache(self._merge)

    def _merge(self, segments):
        n = np.array([len(x) for x in self.inner.encode(segments.to_pylist(), num_threads=1)], np.int64)
        return n, np.zeros(0, np.uint16)

    def __call__(self, texts) -> np.ndarray:
        cut, whole = self.cutter(texts)
        distinct, codes, offsets = factorize(pc.split_pattern(cut, BREAK))
        counts = np.ones(len(distinct), np.int64)
        other = np.flatnonzero(np.asarray(pc.is_null(pc.index_in(distinct, value_set=self.whole_tokens))))
        counts[other] = self.rest.lookup(distinct.take(pa.array(other)))[1]
        upto = np.concatenate([[0], np.cumsum(counts[codes])])
        out = upto[offsets[1:]] - upto[offsets[:-1]]
        for k in np.flatnonzero(np.asarray(whole)):
            out[k] = len(self.library.encode(as_large(texts)[int(k)].as_py()))
        return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    def run(it):
        cache = worker_cache()
        if ("counter", model) not in cache:
            cache["counter", model] = Counter(model)
        for b in it:
            n = cache["counter", model](b["text"])
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pc.binary_length(b["text"]).cast(pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    texts = with_columns_of(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, COUNT_SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
