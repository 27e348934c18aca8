import random
import zlib

import numpy as np

from cohortix.llm import language_id as g
from tests.llm.common import components, crc, documents, lower, odd_documents

SYLLABLES = {"en": "th ing er the and of".split(), "de": "ung sch ein keit und der".split(),
             "fr": "eau oi que les ment é".split(), "es": "ción ado que los ñ os".split()}


def corpus(n=240):
    rng, rows = random.Random(2), []
    for k in range(n):
        lang = list(SYLLABLES)[k % 4]
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((k, text, lang, "s", 0, "c", "p", "k"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus() + [(1000 + i, t, None, *[None] * 5) for i, (_, t, *_) in enumerate(odd_documents())]
    got = {r["doc_id"]: r for r in g.identify(documents(spark, rows)).collect()}
    truth = {r[0]: r[2] for r in rows if r[2]}
    for d in truth:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
    held = [d for d in truth if got[d]["held_out"]]
    assert len(held) > 30 and np.mean([got[d]["lang_pred"] == truth[d] for d in held]) >= 0.95
    for i, (_, t, *_) in enumerate(odd_documents()):
        r = got[1000 + i]
        und = not any(c.isalpha() for c in t or "")
        assert (r["lang_pred"] == "und") == und and (r["score"] == 0) == und and 0 <= r["score"] <= 1


def test_inputs_do_not_leak(spark):
    """lang, source and ids of the held-out fold change no prediction."""
    rows = corpus(160)
    other = [(d, t, "fr" if zlib.crc32(str(d).encode()) % 4 == 2 else lang, "x", 9, *rest)
             for d, t, lang, _, _, *rest in rows]
    a, b = [{r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in g.identify(documents(spark, x)).collect()}
            for x in (rows, other)]
    assert a == b


def test_few_labels_and_empty(spark):
    rows = [(1, "abc def", None, *[None] * 5), (2, None, "en", *[None] * 5)]
    assert {r["lang_pred"] for r in g.identify(documents(spark, rows)).collect()} == {"und"}
    rows = [(k, f"the and of {k}", "en", *[None] * 5) for k in range(8)]
    assert {(r["lang_pred"], r["score"]) for r in g.identify(documents(spark, rows)).collect()} == {("en", 1.0)}
    assert g.identify(documents(spark, [])).collect() == []


def test_filter_keeps_clean_rows(spark):
    rows = corpus(80) + [(900, None, "en", *[None] * 5), (901, "123 !!", "en", *[None] * 5)]
    out = g.with_language(documents(spark, rows))
    assert out.columns == documents(spark).columns
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(80))


def test_svm_separates_and_is_repeatable():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 20))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = g.train_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97
    assert (w == g.train_svm(x, y)).all()


def junk():
    """Texts with letters that are in none of the corpus's languages."""
    rng = random.Random(4)
    return ["Все люди рождаются свободными и равными в своем достоинстве и правах",
            "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
            " ".join("%032x" % rng.getrandbits(128) for _ in range(20)),
            "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(300)),
            "123 456 a 789 !!! 000", "x 123 456 !!! 789"]


def test_filter_rejects_rows_with_letters(spark):
    rows = corpus(240) + [(900 + k, t, None, *[None] * 5) for k, t in enumerate(junk())]
    out = g.with_language(documents(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(240))
    # no labelled row of the language itself: the only profile still rejects
    one = [r for r in corpus(240) if r[2] == "en"] + [(900, junk()[0], None, *[None] * 5)]
    assert 900 not in {r["doc_id"] for r in g.with_language(documents(spark, one)).collect()}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = corpus(200)
    copies = [(300 + k, rows[k][1].upper() if k % 2 and rows[k][1].isascii() else rows[k][1], *rows[k][2:]) for k in range(0, 40)]
    near = [(400 + k, rows[150 + k][1] + " the", *rows[150 + k][2:]) for k in range(40)]
    bad = [(500 + k, t, "en" if k == 0 else None, *[None] * 5) for k, t in enumerate([*junk(), "123 !!", "", None])]
    documents(spark, rows + copies + near + bad).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    largest = {}
    for r in rows + copies + near:
        largest[lower(r[1])] = max(largest.get(lower(r[1]), r), r)
    stay = list(largest.values())
    texts = {r[0]: r[1] for r in stay}
    want = {d: texts[d] for d, _, c in components(stay) if d == c}
    assert len(want) < len(stay) < len(rows + copies + near)
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for d, pieces in got.items():
        ids, at = encoder.encode(want[d], add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["ids_crc32"]) == (at, crc(ids[at:at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
