import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from cohortix.llm import dac, packing, piece_codec, token_counts, token_files
from cohortix.llm.word_tokens import batch_ids
from tests.llm.common import crc, documents, key, odd_documents

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    import sentencepiece as spm
    return spm.SentencePieceProcessor(model_file=PIECES)


def fuzz(parts, n=3000):
    rng = random.Random(5)
    return [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n)]]


def test_words_match_library(encode):
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'S", "İ", "K", "ΑΣ", "é", "É", "́", " ", "\t", "\n",
             "\x1c", "\x85", "\xa0", "a", "B", "1", ".", "!?", "日本", "😀", "\x00", "'", "ß"]
    for p in (parts, parts[3:]):
        texts, got = fuzz(p), []
        for a, b, at, ids in batch_ids(pa.array(texts), WORDS):
            got += [ids[at[i]:at[i + 1]].tolist() for i in range(b - a)]
        assert got == [encode(t) for t in texts]


def test_pieces_match_library(library):
    parts = ["<s>", "</s>", "<unk>", "▁", " ", "  ", "\n", "\t", "\x00", "a", "the", "ing", "é", "日本", "😀", "<0x0A>", "2024", "\xa0"]
    counter, codec = token_counts.Counter(PIECES), piece_codec.Codec(PIECES)
    texts = fuzz(parts)
    want = library.encode([t or "" for t in texts])
    assert counter(pa.array(texts)).tolist() == [len(x) for x in want]
    got, back = [], []
    for a, b, at, ids in codec.encode(pa.array(texts)):
        got += [ids[at[i]:at[i + 1]].tolist() for i in range(b - a)]
        back += codec.decode(at, ids)
    assert got == want
    assert back == [library.decode(x) for x in want]
    # the rebuilt pipeline itself, whole texts, there and back
    assert [codec.whole.encode(t or "", add_special_tokens=False).ids for t in texts[:300]] == want[:300]
    assert [codec.whole.decode(x, skip_special_tokens=False) for x in want[2:300]] == [library.decode(x) for x in want[2:300]]


def test_unigram_model_is_rebuilt():
    from sentencepiece import sentencepiece_model_pb2 as pb
    import sentencepiece as spm
    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", -20, 6) for i in range(256)],
                               ("▁", -3, 1), ("▁he", -4, 1), ("llo", -4.5, 1), ("▁hello", -6, 1), ("l", -7, 1), ("o", -7.5, 1),
                               ("h", -8, 1), ("e", -8.2, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces = False
    lib, ours = spm.SentencePieceProcessor(model_proto=m.SerializeToString()), piece_codec.build(m)
    for t in ["hello", "hello hello", "hell o", "heloll", "hé", "日"]:
        assert ours.encode(t, add_special_tokens=False).ids == lib.encode(t), t


def test_codec_parity_failure_stops():
    with pytest.raises(ValueError):
        piece_codec.Codec._same(["a"], [[1]], [[2]])


def test_counts_and_codec_queries(spark, library):
    rows = odd_documents()
    ids = [library.encode(r[1] or "") for r in rows]
    got = [tuple(r) for r in token_counts.token_counts(documents(spark), PIECES, limit=100).collect()]
    want = [(r[0], len((r[1] or "").encode()), len(x), len(x) > 100) for r, x in zip(rows, ids)]
    assert sorted(got, key=key) == sorted(want, key=key)
    out = piece_codec.encode_decode(documents(spark), PIECES, with_ids=True).collect()
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out], key=key) == sorted(
        [(r[0], len(x), crc(x)) for r, x in zip(rows, ids)], key=key)
    assert all(r["round_trip"] for r in out if "▁" not in r["decoded"] and "\x00" not in r["decoded"] and r["doc_id"] != 11)
    assert token_counts.token_counts(documents(spark, []), PIECES).collect() == []
    assert piece_codec.encode_decode(documents(spark, []), PIECES).collect() == []


def test_dac_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 60000, 5000), rng.integers(0, 1 << 31, 50), np.zeros(700, int)]).astype(np.uint32)
    at = np.array([0, 0, 10, 4000, len(ids)])
    r = dac.Reader(dac.encode([5, None, 7, -1], at, ids))
    assert r.doc_ids == [5, None, 7, -1]
    assert (r.all() == ids).all()
    assert [r.token(i) for i in range(len(ids))] == ids.tolist()
    assert (r.document(2) == ids[10:4000]).all()
    with pytest.raises(IndexError):
        r.token(len(ids))
    with pytest.raises(ValueError):
        dac.Reader(b"x" * 100)


@pytest.mark.parametrize("file_tokens", [4_000_000, 500])
def test_token_files(spark, encode, file_tokens):
    folder, manifest = token_files.write_token_files(documents(spark).repartition(3), WORDS, file_tokens=file_tokens)
    got = [tuple(r) for r in token_files.read_token_files(spark, folder, manifest).orderBy("start").collect()]
    rows = odd_documents()
    want = sorted([(r[0], len(x), crc(x)) for r in rows for x in [encode(r[1]) + [1]]], key=key)
    assert sorted([(d, n, c) for d, _, n, c in got], key=key) == want
    at = 0
    for _, start, n, _ in got:      # gapless
        assert start == at
        at += n
    ids = [d for d, *_ in got]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    folder, manifest = token_files.write_token_files(documents(spark, []), WORDS)
    assert token_files.read_token_files(spark, folder, manifest).collect() == []


@pytest.mark.parametrize("window,open_windows,min_cut", [(4096, 64, 32), (64, 4, 8), (256, 2, 0)])
def test_packing(spark, encode, window, open_windows, min_cut):
    docs = documents(spark).filter("doc_id <> 7 and doc_id is not null").repartition(3)
    out = packing.pack(docs, WORDS, window=window, open_windows=open_windows, min_cut=min_cut, with_ids=True).collect()
    ids = {r[0]: encode(r[1]) + [2] for r in odd_documents() if r[0] not in (7, None)}
    per_doc, per_seq = {}, {}
    for r in out:
        per_doc.setdefault(r["doc_id"], []).append(r)
        per_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(per_doc) == set(ids)
    for d, pieces in per_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = ids[d][at:at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[d]), crc(part))
            assert np.frombuffer(r["ids"], "<u4").tolist() == part
            at += r["length"]
        assert at == len(ids[d])
    padding = 0
    for pieces in per_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= max(min_cut - 1, 0) * len(per_seq)


def test_packing_repeated_and_empty(spark):
    rows = [(1, "a b", *[None] * 6)] * 3 + [(None, None, *[None] * 6)]
    out = packing.pack(documents(spark, rows), WORDS, window=8).collect()
    assert sum(r["length"] for r in out) == 3 * 3 + 1
    assert packing.pack(documents(spark, []), WORDS).collect() == []


def test_small_runs_of_text_are_encoded_at_once(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from cohortix.llm import _util, word_tokens
    seen, real = [], word_tokens._slice_ids
    monkeypatch.setattr(word_tokens, "_slice_ids", lambda t, c: seen.append(t.nbytes) or real(t, c))
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sum(b - a for a, b, _, _ in word_tokens.batch_ids(pa.array(["abc " * 100_000] * 15), path)) == 15    # 6 MB
    assert max(seen) <= 3 << 20
    _util.worker_cache()["other"] = 1
    _util.release_memory(("words", path))
    assert ("words", path) in _util.worker_cache() and "other" not in _util.worker_cache()
