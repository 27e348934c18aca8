"""N-gram Jaccard join by vertical partitioning (operator 1).

Documents link when their sets of ``size``-word shingles have a Jaccard
similarity of at least ``num / 100``.  The global order of shingles (their
64-bit hashes) is cut into fragments; each document's set falls into segments,
one per fragment, and overlaps are counted in each fragment by itself and
summed.

1. One pass over the texts makes each document's set, its size and key (equal
   sets form a class) and the segments of the first ``portion`` of the order.
2. Fragments count, per document, the shingles that a document of another class
   has too.  With at most n/5 of n shingles unmatched in any link (for 0.8), a
   document whose segments hold more unmatched ones links with none.  What is
   left are the live classes; this prunes most of a corpus and loses no link.
3. The live classes' whole sets are cut into fragments again.  A fragment gives
   each shingle its number of classes and a dense code.
4. In the order of rarity, two linked classes share a shingle among the first
   n/5 + 1 of each (prefix).  Classes that share one are candidates, if its
   places in both leave room for the overlap that their sizes ask for.
5. A candidate pair's overlap is counted per fragment from the codes, and the
   partial counts are summed per pair.
6. Candidates come star by star: one centre per shingle against the others,
   only between different components.  When what is left is small, or stars
   stop linking, all remaining candidates between components are counted.  So
   a group of near copies costs about its size, not the square, and no
   candidate that could change a component is left out.

``ngram_components`` has a row per document; pairs are never listed per group.
``ngram_links`` is the join with all its links: steps 1 to 5 for every candidate
pair of classes, whose answer is the linked classes and each document's class
and number of links.

Edge cases: no words, null or empty text: no shingles, linked with nothing
(such documents are not linked with one another); fewer words than ``size``:
one shingle; null doc_ids take part, and the smallest non-null doc_id names the
component; rows that repeat a doc_id are documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import discard, release_memory, with_columns_of, written
from .graph import connected_components
from .segments import row_slices
from .shingles import set_keys, shingle_sets

FRAGMENT_BYTES = 8 << 20
SLICE_BYTES = 1 << 20       # text whose sets a task holds at once
CUTS = 4
PAIRS_PER_ENTRY = 64        # so many comparisons per prefix entry are done at once
BLOCK_SCHEMA = ("frag int, part int, seq int, rows int, idx binary, counts binary, keys binary, hashes binary, "
                "doc_ids binary, known binary, ns binary, ms binary, k1 binary")


def _texts(docs: DataFrame) -> DataFrame:
    return with_columns_of(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _width(entries: float, fragments: int) -> int:
    """Bytes per hash inside a fragment, so that a chance meeting of two
    shingles there is rare (it only makes the filter keep more)."""
    return min(8, max(3, math.ceil((math.log2(max(entries, 2)) + 6 - math.log2(fragments)) / 8)))


def _cut(hashes: np.ndarray, doc: np.ndarray, fragments: int, limit: int):
    """Yield (fragment, positions of its hashes) for hashes below ``limit``;
    positions keep the order of the documents."""
    pos = np.flatnonzero(hashes < np.uint64(limit)) if limit < 1 << 64 else np.arange(len(hashes))
    frag = np.zeros(len(pos), np.int64)
    if fragments > 1:
        frag[:] = np.minimum(hashes[pos] // np.uint64(limit // fragments), np.uint64(fragments - 1))
    order = np.argsort(frag, kind="stable")
    pos, frag = pos[order], frag[order]
    bounds = np.searchsorted(frag, np.arange(fragments + 1))
    for f in range(fragments):
        if bounds[f] < bounds[f + 1]:
            yield f, pos[bounds[f]:bounds[f + 1]]


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    a = np.zeros((len(raw) // width, 8), np.uint8)
    a[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return a.reshape(-1).view("<u8")


def _blocks(docs: DataFrame, size: int, limit: int, fragments: int, width: int) -> DataFrame:
    """The segments of a run of documents as one row per fragment, and a row
    that describes the documents (frag -1)."""
    def run(it):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        release_memory()
        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        types = [pa.int32()] * 4 + [pa.binary()] * 9
        pieces = (b.slice(*piece) for b in it for piece in row_slices(b["text"], SLICE_BYTES))
        for seq, b in enumerate(pieces):
            pa.default_memory_pool().release_unused()
            offsets, hashes = shingle_sets(b["text"], size)
            k1 = set_keys(offsets, hashes)
            n = np.diff(offsets)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            m, rows = np.zeros(len(n), np.int64), []
            for f, pos in _cut(hashes, doc, fragments, limit):
                idx, counts = np.unique(doc[pos], return_counts=True)
                m[idx] += counts
                rows.append([f, part, seq, len(n), idx.astype("<i4").tobytes(), counts.astype("<i4").tobytes(),
                             k1[idx].astype("<i8").tobytes(), _pack(hashes[pos], width)] + [None] * 5)
            rows.append([-1, part, seq, len(n), None, None, None, None,
                         pc.fill_null(b["doc_id"], 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                         pc.is_valid(b["doc_id"]).to_numpy(zero_copy_only=False).astype("u1").tobytes(),
                         n.astype("<i8").tobytes(), m.astype("<i8").tobytes(), k1.astype("<i8").tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _fragment_entries(pdf: pd.DataFrame, width: int):
    """(hashes, class keys, lengths of the blocks) of a fragment's blocks."""
    hashes = [_unpack(h, width) for h in pdf["hashes"]]
    keys = [np.repeat(np.frombuffer(k, "<i8"), np.frombuffer(c, "<i4")) for k, c in zip(pdf["keys"], pdf["counts"])]
    return np.concatenate(hashes), np.concatenate(keys), [len(h) for h in hashes]


def _shared_counts(width: int):
    """Per block and document: shingles that another class has too."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, keys, lengths = _fragment_entries(pdf, width)
        order = np.argsort(hashes)
        h, k = hashes[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)
        shared = np.zeros(len(h), np.int32)
        shared[order] = np.repeat(several, np.diff(np.concatenate([first, [len(h)]])))
        out, at = [], 0
        for counts, n in zip(pdf["counts"], lengths):
            c = np.frombuffer(counts, "<i4")
            out.append(np.add.reduceat(shared[at:at + n], np.concatenate([[0], np.cumsum(c)[:-1]])).astype("<i4").tobytes())
            at += n
        return pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "idx": pdf["idx"], "shared": out})
    return run


def _live_documents(slack: int):
    """Of one batch: documents that may link, from the fragments' counts."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["ns"].notna()].iloc[0]
        n, m = np.frombuffer(head["ns"], "<i8"), np.frombuffer(head["ms"], "<i8")
        shared = np.zeros(len(n), np.int64)
        for idx, s in zip(pdf["idx"], pdf["shared"]):
            if s is not None and idx is not None:
                shared[np.frombuffer(idx, "<i4")] += np.frombuffer(s, "<i4")
        live = (n > 0) & (shared >= m - n * slack // 100)
        ids = pd.array(np.frombuffer(head["doc_ids"], "<i8").copy(), dtype="Int64")
        ids[np.frombuffer(head["known"], "u1") == 0] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n": n, "cls": np.frombuffer(head["k1"], "<i8"), "live": live})
    return run


def _document_classes(docs: DataFrame, size: int, num: int, portion: float) -> DataFrame:
    """One row per document: doc_id, n, cls, live."""
    # bytes of text bound the number of words, which sets the number of fragments
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    entries = max(total / 6 * portion, 1)
    fragments = max(1, math.ceil(entries * 6 / FRAGMENT_BYTES))
    width = _width(entries, fragments)
    blocks = written(_blocks(docs, size, int(portion * (1 << 64)), fragments, width), "join-blocks")
    shared = blocks.filter("frag >= 0").select("frag", "part", "seq", "idx", "counts", "keys", "hashes").groupBy(
        "frag").applyInPandas(_shared_counts(width), "part int, seq int, idx binary, shared binary")
    heads = blocks.filter("frag < 0").select("part", "seq", "doc_ids", "known", "ns", "ms", "k1")
    both = heads.withColumn("idx", F.lit(None).cast("binary")).withColumn("shared", F.lit(None).cast("binary")).unionByName(
        shared, allowMissingColumns=True)
    out = written(both.groupBy("part", "seq").applyInPandas(
        _live_documents(100 - num), "doc_id bigint, n bigint, cls bigint, live boolean"), "join-documents")
    discard(blocks)
    return out


def _live_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(cls, n, hashes) of the live classes, from the text of one document of
    each."""
    pick = classes.filter("live").groupBy("cls").agg(F.min("doc_id").alias("pick"))

    def run(it):
        import pyarrow as pa

        for b in (b.slice(*piece) for b in it for piece in row_slices(b["text"], SLICE_BYTES)):
            offsets, hashes = shingle_sets(b["text"], size)
            k1 = set_keys(offsets, hashes)
            want = b["cls"].to_numpy(zero_copy_only=False)
            rows = [k for k in range(len(k1)) if k1[k] == want[k]]
            yield pa.RecordBatch.from_pydict({
                "cls": pa.array([int(k1[k]) for k in rows], pa.int64()),
                "n": pa.array([int(offsets[k + 1] - offsets[k]) for k in rows], pa.int64()),
                "hashes": pa.array([hashes[offsets[k]:offsets[k + 1]].tobytes() for k in rows], pa.binary())})

    text = docs.join(pick, docs["doc_id"].eqNullSafe(pick["pick"])).select("cls", "text")
    sets = text.mapInArrow(run, "cls bigint, n bigint, hashes binary")
    return sets.groupBy("cls").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))


def _coded_sets(sets: DataFrame, num: int) -> tuple[DataFrame, str]:
    """Per live class its size, how common its shingles are (weight), its
    prefix as codes with their places in the order of rarity, and its segments,
    one per cut of the global order; and the type of the codes.  Classes with
    too few shared shingles are left out.

    A fragment numbers the shingles that several live classes have.  Its answer
    is a row per bucket of classes, so rows follow fragments, not classes."""
    size = sets.agg(F.sum("n").alias("s"), F.count("*").alias("c")).first()
    total = size["s"] or 0
    fragments = max(1, math.ceil(total * 16 / FRAGMENT_BYTES))
    buckets = max(1, size["c"] // 256)
    code = "<u4" if total < 1 << 31 else "<u8"

    def cut(it):
        for pdf in it:
            if not len(pdf):
                continue
            sizes = pdf["n"].to_numpy()
            hashes = np.concatenate([np.frombuffer(h, np.uint64) for h in pdf["hashes"]])
            doc = np.repeat(np.arange(len(pdf)), sizes)
            keys = pdf["cls"].to_numpy()
            for f, pos in _cut(hashes, doc, fragments, 1 << 64):
                idx, counts = np.unique(doc[pos], return_counts=True)
                yield pd.DataFrame({"frag": [f], "keys": [keys[idx].astype("<i8").tobytes()],
                                    "ns": [sizes[idx].astype("<i8").tobytes()],
                                    "counts": [counts.astype("<i4").tobytes()], "hashes": [_pack(hashes[pos], 8)]})

    def code_fragment(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["frag"].iloc[0])
        hashes, keys, _ = _fragment_entries(pdf, 8)
        ns = np.concatenate([np.repeat(np.frombuffer(x, "<i8"), np.frombuffer(c, "<i4"))
                             for x, c in zip(pdf["ns"], pdf["counts"])])
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        rank = np.cumsum(counts > 1) - 1
        keep = counts[inverse] > 1
        codes, freqs, keys, ns = (rank[inverse] * fragments + f)[keep], counts[inverse][keep], keys[keep], ns[keep]
        bucket = np.mod(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        parts = [order[x:y] for x, y in zip(at[:-1], at[1:]) if x < y]
        return pd.DataFrame({"bucket": [int(bucket[o[0]]) for o in parts],
                             "keys": [keys[o].astype("<i8").tobytes() for o in parts],
                             "ns": [ns[o].astype("<i8").tobytes() for o in parts],
                             "codes": [codes[o].astype(code).tobytes() for o in parts],
                             "freqs": [freqs[o].astype("<u4").tobytes() for o in parts]})

    def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
        def column(name, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in pdf[name]])
        keys, ns, codes, freqs = column("keys", "<i8"), column("ns", "<i8"), column("codes", code), column("freqs", "<u4")
        order = np.lexsort((codes, freqs, keys))
        keys, ns, codes, freqs = keys[order], ns[order], codes[order], freqs[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out = []
        for x, y in zip(first, [*first[1:], len(keys)]):
            n, mine = int(ns[x]), codes[x:y]
            slack = n * (100 - num) // 100
            if y - x < n - slack:
                continue
            unmatched = n - (y - x)      # the rarest of all: in no other class
            prefix = mine[:slack + 1 - unmatched].astype(np.int64)
            cuts = (mine.astype(np.uint64) % np.uint64(fragments)) * np.uint64(CUTS) // np.uint64(fragments)
            out.append((int(keys[x]), n, float(np.log(freqs[x:y]).sum() / n),
                        [{"code": int(c), "pos": unmatched + i} for i, c in enumerate(prefix)],
                        [np.sort(mine[cuts == c]).tobytes() for c in range(CUTS)]))
        return pd.DataFrame(out, columns=["cls", "n", "weight", "prefix", "segments"])

    answers = sets.mapInPandas(cut, "frag int, keys binary, ns binary, counts binary, hashes binary").groupBy(
        "frag").applyInPandas(code_fragment, "bucket bigint, keys binary, ns binary, codes binary, freqs binary")
    return answers.groupBy("bucket").applyInPandas(
        prefixes, "cls bigint, n bigint, weight double, prefix array<struct<code:bigint,pos:bigint>>, "
        "segments array<binary>"), code


def _overlap(code: str):
    @F.pandas_udf("bigint")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(x, code), np.frombuffer(y, code), assume_unique=True))
                          for x, y in zip(a, b)], dtype="int64")
    return overlap


def _verified(pairs: DataFrame, segments: DataFrame, num: int, code: str) -> DataFrame:
    """The linked ones of ``pairs`` (a, b, na, nb): overlaps per fragment,
    summed per pair."""
    left = pairs.join(segments.select(F.col("cls").alias("a"), "cut", F.col("seg").alias("seg_a")), "a")
    both = left.join(segments.select(F.col("cls").alias("b"), "cut", F.col("seg").alias("seg_b")), ["b", "cut"])
    partial = both.select("a", "b", "na", "nb", _overlap(code)("seg_a", "seg_b").alias("o"))
    sums = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return sums.filter(f"100 * o >= {num} * (na + nb - o)").select("a", "b")


def _may_link(num: int, a: str, b: str) -> str:
    """SQL: sizes and places of a shared shingle allow a link.  A pair needs an
    overlap of t; its first common shingle lies behind so many of either set
    that at most n - t are unmatched."""
    t = f"(({num} * ({a}.n + {b}.n) + {99 + num}) div {100 + num})"
    return (f"100 * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) "
            f"and {a}.pos <= {a}.n - {t} and {b}.pos <= {b}.n - {t}")


def _class_components(lists: DataFrame, segments: DataFrame, num: int, code: str) -> DataFrame:
    """(cls, comp) of the classes that link.

    Stars first: the centre of a shingle's list is the class whose shingles are
    the most common (near copies of one text have that text as such), later any
    other.  Then the candidates between components: members outside a list's
    largest component against all others."""
    spark = lists.sparkSession
    comps, seen, links, star_round, entries = None, None, None, 0, lists.count()
    while True:
        if comps is None:
            at, full = lists.withColumn("comp", F.col("cls")), False
        else:
            at = written(lists.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "join-lists")
            inner = at.groupBy("code", "comp").agg(F.count("*").alias("c"))
            major = inner.groupBy("code").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"))
            major = major.filter("m > top.c").select("code", "m", F.col("top.comp").alias("major"), F.col("top.c").alias("held"))
            rows = major.agg(F.sum((F.col("m") - F.col("held")) * F.col("m")).alias("rows")).first()["rows"]
            if not rows:
                return comps
            full = not new or rows <= PAIRS_PER_ENTRY * entries
        if full:
            minor = at.join(major, "code").filter("comp <> major").select("code", "cls", "n", "pos", "comp")
            pairs = minor.alias("a").join(at.alias("b"), F.expr(
                f"a.code = b.code and a.comp <> b.comp and {_may_link(num, 'a', 'b')}"))
            pairs = pairs.selectExpr("if(a.cls < b.cls, a.cls, b.cls) as a", "if(a.cls < b.cls, b.cls, a.cls) as b",
                                     "if(a.cls < b.cls, a.n, b.n) as na", "if(a.cls < b.cls, b.n, a.n) as nb")
        else:
            liking = F.col("weight") if not star_round else F.xxhash64("cls", F.lit(star_round)).cast("double")
            centre = at.groupBy("code").agg(F.max(F.struct(liking.alias("l"), "cls", "n", "pos", "comp")).alias("c"))
            centre = centre.select("code", "c.*")
            pairs = at.alias("a").join(centre.alias("b"), F.expr(
                f"a.code = b.code and a.comp <> b.comp and {_may_link(num, 'a', 'b')}")).selectExpr(
                "a.cls as a", "b.cls as b", "a.n as na", "b.n as nb")
        pairs = pairs.distinct()
        if seen is not None:
            told = seen.unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(told, ["a", "b"], "left_anti")
        pairs = written(pairs, "join-pairs")
        found = written(_verified(pairs, segments, num, code), "join-links")
        new = found.count()
        seen = pairs.select("a", "b") if seen is None else seen.unionByName(pairs.select("a", "b"))
        links = found if links is None else links.unionByName(found)
        if new:
            comps = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(
                F.col("node").alias("cls"), F.col("component").alias("comp"))
        elif comps is None:
            comps = spark.createDataFrame([], "cls bigint, comp bigint")
        if full:
            return comps
        star_round += 1


def _candidates(docs: DataFrame, size: int, num: int, portion: float) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Classes of the documents; of the live classes the prefix entries and the
    segments, and the type of their codes."""
    texts = _texts(docs)
    classes = _document_classes(texts, size, num, portion)
    sets = written(_live_sets(texts, classes, size), "join-sets")
    coded, code = _coded_sets(sets, num)
    ready = written(coded, "join-prefixes")
    discard(sets)
    segments = ready.select("cls", F.posexplode("segments").alias("cut", "seg"))
    entries = ready.select("cls", "n", "weight", F.inline("prefix"))
    return classes, written(entries, "join-lists"), segments, code


def ngram_links(docs: DataFrame, size: int = 5, num: int = 80, portion: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """The join itself: (documents, pairs).

    documents: doc_id, n_shingles, class_id (equal sets), n_links (linked other
    documents, those of the own class included) of every document.
    pairs: class_a < class_b of every two linked classes.  Every candidate pair
    is verified, so pairs of a group of near copies are as many as its links."""
    classes, lists, segments, code = _candidates(docs, size, num, portion)
    pairs = lists.alias("a").join(lists.alias("b"), F.expr(
        f"a.code = b.code and a.cls < b.cls and {_may_link(num, 'a', 'b')}")).selectExpr(
        "a.cls as a", "b.cls as b", "a.n as na", "b.n as nb").distinct()
    pairs = written(pairs, "join-pairs")
    links = written(_verified(pairs, segments, num, code), "join-links")
    discard(pairs)
    members = classes.filter("n > 0").groupBy("cls").agg(F.count("*").alias("m"))
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    others = both.join(members.select(F.col("cls").alias("other"), "m"), "other").groupBy("cls").agg(
        F.sum("m").alias("outside"))
    counts = members.join(others, "cls", "left").select(
        "cls", (F.col("m") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    documents = classes.filter("n > 0").join(counts, "cls").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), "n_links")
    documents = documents.unionByName(classes.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("class_id"),
        F.lit(0).cast("bigint").alias("n_links")))
    return documents, links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def ngram_components(docs: DataFrame, size: int = 5, num: int = 80, portion: float = 0.4) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    classes, lists, segments, code = _candidates(docs, size, num, portion)
    comps = _class_components(lists, segments, num, code)
    of_class = classes.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low")).join(
        comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = of_class.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_class = of_class.join(lowest, "comp").select("cls", "component_id")
    linked = classes.filter("n > 0").join(of_class, "cls").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(classes.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, size: int = 5, num: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each component
    (documents without a doc_id stay)."""
    stay = ngram_components(docs, size, num).filter("doc_id = component_id").select(
        F.col("doc_id").alias("__join_keep")).distinct()
    ids = docs["doc_id"].cast("bigint")
    kept = docs.join(stay, ids == F.col("__join_keep"), "left_semi")
    return kept.unionByName(docs.filter(docs["doc_id"].isNull()))
