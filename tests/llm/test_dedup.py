import hashlib
from collections import defaultdict

import pytest

from cohortix.llm import grace_dedup as g
from tests.llm.common import documents, key, lower, odd_documents


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[lower(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(lower(r[1]).encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("budget", [64 << 20, 3000])      # one table; spill files, recursively
def test_decisions(spark, budget):
    got = [tuple(r) for r in g.dedup_decisions(documents(spark), budget).collect()]
    assert sorted(got, key=key) == brute(odd_documents())


def test_recursion_and_spill():
    recs = [(hashlib.sha256(b"%d" % (k % 700)).digest(), b"%d" % (k % 700) * 50, k, 1, 1) for k in range(5000)]
    got = {r[1]: (r[2], r[3]) for r in g.grace(iter(recs), budget=5000)}
    assert len(got) == 700 and sum(n for _, n in got.values()) == 5000
    assert all(keep == max(k for k in range(5000) if b"%d" % (k % 700) * 50 == text) for text, (keep, _) in list(got.items())[:50])


def test_unequal_contents_of_one_hash_stop_the_job():
    with pytest.raises(ValueError):
        list(g.grace(iter([(b"h" * 32, b"a", 1, 1, 1), (b"h" * 32, b"b", 2, 1, 1)]), budget=1000))


def test_dedup_keeps_columns_and_one_row(spark):
    out = g.dedup(documents(spark))
    assert out.columns == documents(spark).columns
    kept = [(r["doc_id"], lower(r["text"])) for r in out.collect()]
    assert len({t for _, t in kept}) == len(kept)
    assert len(kept) == len({lower(r[1]) for r in odd_documents()})
    assert g.dedup(documents(spark, [])).collect() == []
    assert g.dedup_decisions(documents(spark, [])).collect() == []
