"""SentencePiece encoding and decoding on the tokenizers library (operator 4).

``build`` reads the model protobuf and rebuilds it as a tokenizers pipeline:
the normaliser (character map, extra white space), the space marker with its
dummy prefix, unigram scores or the merges that the scores of a BPE vocabulary
imply, byte fallback and the decoder.  Texts are cut where no piece can span
(``piece_model``) and the distinct segments encoded in multithreaded batches.

Parity is verified while it runs: each distinct segment that a worker meets is
also encoded by the SentencePiece library; a difference stops the job.

Edge cases: null text is empty, has no ids and decodes to the empty string; a
text with a NUL character, and any text under a model that cannot be cut, is
encoded whole; null, repeated and clashing columns pass row by row; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import with_columns_of, worker_cache
from .piece_model import BPE, BYTE, CONTROL, MARK, NORMAL, UNIGRAM, UNKNOWN, USER_DEFINED, Cutter, parse
from .segments import BREAK, RaggedCache, as_large, factorize, gather, row_slices, spans

CODEC_SCHEMA = ("doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_chars bigint, round_trip boolean, "
                "ids array<int>, decoded string")


def implied_merges(proto) -> list[tuple[str, str]]:
    """All splits of a piece into two pieces, best score first."""
    score = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, USER_DEFINED)}
    rank = {p.piece: i for i, p in enumerate(proto.pieces)}
    found = [(-s, rank[piece[:k]], rank[piece[k:]], piece[:k], piece[k:]) for piece, s in score.items()
             for k in range(1, len(piece)) if piece[:k] in score and piece[k:] in score]
    return [(a, b) for *_, a, b in sorted(found)]


def build(proto, prefix: bool | None = None):
    """A tokenizers pipeline with the ids of the SentencePiece model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers
    norm, trainer = proto.normalizer_spec, proto.trainer_spec
    prefix = norm.add_dummy_prefix if prefix is None else prefix
    unk = proto.pieces[trainer.unk_id].piece
    if trainer.model_type == UNIGRAM:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], trainer.unk_id, trainer.byte_fallback)
    elif trainer.model_type == BPE:
        vocab = {p.piece: i for i, p in enumerate(proto.pieces)}
        model = models.BPE(vocab, implied_merges(proto), unk_token=unk, fuse_unk=True,
                           byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    tok = Tokenizer(model)
    steps = []
    if norm.precompiled_charsmap:
        steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                    + ([decoders.Strip(" ", 1, 0)] if prefix else []))
    return tok


class Codec:
    """Encodes and decodes batches; verified against the library."""

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece as spm

        proto = parse(path)
        self.cutter = Cutter(proto)
        self.whole_lib = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.whole = build(proto)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.inner = build(proto, prefix=False)
        proto.normalizer_spec.add_dummy_prefix = False
        self.inner_lib = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.cache = RaggedCache(self._segments, limit=500_000, dtype=np.int32)
        # the bytes of each piece, for decoding by position
        out = []
        for p in proto.pieces:
            if p.type == BYTE:
                out.append(bytes([int(p.piece[3:-1], 16)]))
            elif p.type == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(b"" if p.type == CONTROL else p.piece.replace(MARK, " ").encode())
        self.lengths = np.array([len(x) for x in out], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(out), np.uint8)

    @staticmethod
    def _same(texts, ours, theirs):
        for t, a, b in zip(texts, ours, theirs):
            if a != b:
                raise ValueError(f"the two libraries differ on {t[:80]!r}: {a[:20]} and {b[:20]}")

    def _segments(self, segments):
        lengths, flat = [], []
        for k in range(0, len(segments), 16384):        # an encoding is far larger than its ids
            texts = segments.slice(k, 16384).to_pylist()
            ids = [e.ids for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]
            self._same(texts, ids, self.inner_lib.encode(texts, num_threads=1))
            lengths += [len(x) for x in ids]
            flat.append(np.fromiter((i for x in ids for i in x), np.int32))
        return np.array(lengths, np.int64), np.concatenate(flat)

    def encode(self, texts):
        """Yield (first, last + 1, offsets, ids) in runs of bounded size."""
        for row, count in row_slices(texts):
            for a, b, upto, ids in self._encode(texts.slice(row, count)):
                yield row + a, row + b, upto, ids

    def _encode(self, texts):
        cut, whole = self.cutter(texts)
        distinct, codes, offsets = factorize(pc.split_pattern(cut, BREAK))
        starts, lengths, flat = self.cache.lookup(distinct)
        whole_at = np.flatnonzero(np.asarray(whole))
        for a, b in spans(offsets):
            part = codes[offsets[a]:offsets[b]]
            ids = gather(part, starts, lengths, flat)
            upto = np.concatenate([[0], np.cumsum(lengths[part])])[offsets[a:b + 1] - offsets[a]]
            alone = [int(k) for k in whole_at if a <= k < b]
            if alone:
                strings = as_large(texts).take(alone).to_pylist()
                got = [e.ids for e in self.whole.encode_batch_fast(strings, add_special_tokens=False)]
                self._same(strings, got, self.whole_lib.encode(strings, num_threads=1))
                docs = [ids[upto[k]:upto[k + 1]] for k in range(b - a)]
                for k, x in zip(alone, got):
                    docs[k - a] = np.array(x, np.int32)
                upto = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
                ids = np.concatenate(docs)
            yield a, b, upto, ids

    def decode(self, upto: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of documents whose ids lie between the offsets."""
        raw = gather(ids, self.starts, self.lengths, self.bytes).tobytes()
        at = np.concatenate([[0], np.cumsum(self.lengths[ids])])[upto]
        drop = 1 if self.prefix else 0
        out = []
        for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
            t = raw[a:z]
            out.append((t[drop:] if drop and t[:1] == b" " else t).decode("utf-8", "replace"))
        return out


def encode_decode(docs: DataFrame, model: str, threads: int = 2, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32, decoded_chars, round_trip
    (the decoded text is the text); with ``with_ids`` also ids and decoded."""
    def run(it):
        cache = worker_cache()
        if ("codec", model) not in cache:
            cache["codec", model] = Codec(model, threads)
        codec = cache["codec", model]
        for b in it:
            for first, last, upto, ids in codec.encode(b["text"]):
                texts, back = b["text"].slice(first, last - first).to_pylist(), codec.decode(upto, ids)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b["doc_id"].slice(first, last - first),
                    "n_tokens": pa.array(np.diff(upto), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(upto[:-1], upto[1:])], pa.int64()),
                    "decoded_chars": pa.array([len(t) for t in back], pa.int64()),
                    "round_trip": pa.array([x == y for x, y in zip(texts, back)], pa.bool_()),
                    "ids": pa.array([ids[x:y] for x, y in zip(upto[:-1], upto[1:])] if with_ids else [None] * len(back),
                                    pa.list_(pa.int32())),
                    "decoded": pa.array(back if with_ids else [None] * len(back), pa.string())})

    texts = with_columns_of(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = texts.mapInArrow(run, CODEC_SCHEMA)
    return out if with_ids else out.drop("ids", "decoded")
