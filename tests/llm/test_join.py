import random

from cohortix.llm import ngram_join as g
from cohortix.llm.graph import connected_components
from tests.llm.common import components, documents, key, odd_documents, shingles, words


def run(spark, rows, **kw):
    return sorted([tuple(r) for r in g.ngram_components(documents(spark, rows), **kw).collect()], key=key)


def test_odd_documents(spark):
    rows = odd_documents()
    assert run(spark, rows) == sorted(components(rows), key=key)


def test_random_near_copies(spark):
    rng, rows = random.Random(3), []
    for base in range(12):
        w = [f"b{base}y{rng.randrange(60)}" for _ in range(rng.randrange(3, 90))]
        for k in range(rng.randrange(1, 12)):
            for _ in range(rng.randrange(0, 4)):        # chains: a copy of a copy
                w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w), None, None, None, None, None, None))
    assert run(spark, rows) == sorted(components(rows), key=key)
    assert run(spark, rows, portion=0.7) == sorted(components(rows), key=key)


def test_fragment_kernels_agree_with_any_cut(spark, monkeypatch):
    monkeypatch.setattr(g, "FRAGMENT_BYTES", 2000)        # many fragments
    rows = odd_documents()
    assert run(spark, rows) == sorted(components(rows), key=key)


def test_empty_and_one_per_component(spark):
    assert run(spark, []) == []
    rows = odd_documents()
    out = g.one_per_component(documents(spark))
    assert out.columns == documents(spark).columns
    want = {c for _, _, c in components(rows) if c is not None}
    assert {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 50), (None, 3), (7, 7), (200, 201), (202, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, 50: 50, 100: 50, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def links(rows):
    """Number of links per row and linked pairs of different sets, by comparing all pairs."""
    sets = [frozenset(shingles(r[1])) for r in rows]
    n, pairs = [0] * len(sets), set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                n[a] += 1
                n[b] += 1
                if x != y:
                    pairs.add(frozenset([x, y]))
    return sets, n, pairs


def test_links_against_all_pairs(spark):
    rng = random.Random(8)
    rows = list(odd_documents())
    for k in range(60):       # chains: neighbours link, the ends of a chain do not
        w = words(50 + k % 6, 120).split()
        for j in range(k // 6):
            w[3 * j] = f"new{j}"
        rows.append((1000 + k, " ".join(w), *rows[0][2:]))
    rng.shuffle(rows)
    sets, n, want = links(rows)
    docs, pairs = g.ngram_links(documents(spark, rows).repartition(3))
    got = docs.collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got), key=key) == sorted(
        ((r[0], len(s), k) for r, s, k in zip(rows, sets, n)), key=key)
    text = {}       # class of a set, by the ids that are unique
    unique = {r[0]: s for r, s in zip(rows, sets) if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1}
    for r in got:
        if r["doc_id"] in unique and r["class_id"] is not None:
            assert text.setdefault(r["class_id"], unique[r["doc_id"]]) == unique[r["doc_id"]]
    pairs = [tuple(r) for r in pairs.collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert {frozenset([text[a], text[b]]) for a, b in pairs} == want and len(pairs) == len(want) > 500
    none, no_pairs = g.ngram_links(documents(spark, []))
    assert none.collect() == [] and no_pairs.collect() == []


def test_sets_are_made_of_small_runs_of_text(spark):
    from cohortix.llm import ngram_join
    texts = [(k, f"{k} " + "abcdefg " * 40_000) for k in range(14)]      # 4.5 MB
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    heads = ngram_join._blocks(docs, 5, 1 << 64, 2, 8).filter("frag < 0").collect()
    assert max(r.rows for r in heads) * 320_000 <= 2 << 20 and sum(r.rows for r in heads) == 14
