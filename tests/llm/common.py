"""Small tables with every odd case, and plain-Python versions to compare with."""

import re
import zlib

import numpy as np

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string, part string, keep_id string"


def words(k, n, step=1):
    return " ".join(f"w{k}x{i * step}" for i in range(n))


def odd_documents():
    near = words(7, 200).split()
    rows = [
        (1, None), (2, ""), (3, "   \t\n "), (4, "one two three"), (5, "One TWO three"), (6, "one two three"),
        (7, words(1, 60)), (7, words(1, 60)), (8, words(1, 60)), (9, words(2, 30000)),
        (None, "no id here at all today"), (None, None), (10, "É é ÀB àb"), (11, "a\x00b <s> </s> <|endoftext|> ▁ x  y"),
        (12, "12345 !!! ..."), (13, "x" * 5000),
    ]
    for k in range(40):     # a group of near copies: each with one changed word
        w = list(near)
        w[5 * k % 200] = f"changed{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, words(20 + k, 80) + " " + words(99, 20)) for k in range(15)]     # share a passage, no link
    return [(i, t, "en", "s", 0, "c", "p", "k") for i, t in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def components(rows):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(s), low.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)
