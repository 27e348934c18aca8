"""Hierarchical language identification (operator 8).

The family of a text is predicted first; within the family, one-versus-one
linear support vector machines vote on the language.  Families come from
``FAMILIES`` (a parameter); a language it lacks is a family of its own.

Features: hashed byte 1- to 3-grams of the whole text, lower-cased, with
everything but letters as one blank; square roots of relative frequencies,
scaled to unit length.

Training: a bounded sample of labelled rows, ``per_language`` rows per language
in expectation, chosen by a hash of the doc_id from all labelled rows of the
training fold; their features are made on the executors and each machine is
trained in a task of its own, on at most twice the rows of a language.  Only
the weights (languages squared times ``DIM``) come to the driver.

Filter: the winner of a vote always scores 0.5 or more, so the score alone
cannot say that a text is in none of the languages.  ``with_language`` asks two
quantities that can fail: the mean log-likelihood of the text's n-grams under
the predicted language's profile, and the share of letters among its non-blank
bytes.  Each language's bounds are fitted on its training rows, every row
measured against the profile of the others.

Edge cases: null text, or text without a letter: ``und`` with score 0; a null
doc_id counts as the text '' in the fold's checksum; with no labelled row every
text is ``und``; one language or one family needs no machine; ties go to the
first in sorted order; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import release_memory, with_columns_of, written

DIM = 4096
UND = "und"
ODD, MARGIN, SMOOTH = 0.005, 0.5, 0.1      # of the profiles: odd training rows, nats below the others, weight of a uniform text

# Language families by ISO 639-1 code.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nl": "germanic", "no": "germanic",
    "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance",
    "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic",
    "sl": "slavic", "sr": "slavic", "uk": "slavic",
}

# ASCII letters lower-cased, other ASCII to blank, further bytes as they are
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32) if c < 128 else c for c in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of a text's hashed byte n-grams."""
    if not text.isascii():
        text = text.lower()
    raw = b" " + b" ".join(text.encode("utf-8", "replace").translate(_TABLE).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.bincount(a, minlength=256).astype(np.float64)
    v = np.zeros(DIM)
    v[:256] = counts[:256]
    v[32] = 0.0
    if len(a) > 1:
        v += np.bincount(((a[:-1] * 257 + a[1:]) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    if len(a) > 2:
        v += np.bincount(((a[:-2] * 66049 + a[1:-1] * 257 + a[2:]) * np.uint32(2246822519)) >> np.uint32(20), minlength=DIM)
    v = np.sqrt(v)
    return (v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32)


def letter_share(text: str) -> float:
    """Bytes of letters among the bytes that are not blank."""
    raw = text.encode("utf-8", "replace")
    return sum(map(len, raw.translate(_TABLE).split())) / (sum(map(len, raw.split())) or 1)


def fold(col="doc_id"):
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, cost: float = 10.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss (y is +1
    or -1), by dual coordinate descent in a fixed order of a fixed seed."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    weight = {s: len(y) / (2.0 * max((y == s).sum(), 1)) for s in (-1, 1)}     # classes count alike
    diag = np.array([0.5 / (cost * weight[s]) for s in y])
    norm = (x * x).sum(axis=1) + diag
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + diag[i] * alpha[i]
            step = max(alpha[i] - g / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w


def profile(x: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Of a language's feature rows: log-probabilities of the features, the
    least likelihood and the least share of letters of a text in it.

    A row's likelihood is taken without the row itself.  ``ODD`` of the rows may
    lie below the bounds before the margins, so a few wrong labels move none."""
    p = x.astype(np.float64) ** 2
    total, n = p.sum(axis=0), len(p)

    def logs(mass, rows):
        return np.log((mass + SMOOTH * max(rows, 1) / DIM) / (rows + SMOOTH * max(rows, 1)))

    likely = np.array([row @ logs(np.maximum(total - row, 0.0), n - 1) for row in p])
    k = int(ODD * n)
    return logs(total, n), float(np.sort(likely)[k] - MARGIN), float(np.sort(share)[k] / 2)


def fit(docs: DataFrame, families: dict[str, str] | None = None, per_language: int = 400, profiles: bool = False) -> dict:
    """The model: languages by family and a weight vector per machine; with
    ``profiles`` also each language's profile and bounds."""
    families = FAMILIES if families is None else families
    rows = with_columns_of(docs, ["doc_id", "text", "lang"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"))
    labelled = rows.filter(F.col("lang").isNotNull() & (fold() != 2) & F.col("text").rlike(r"\p{L}"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in counts.collect()}       # one row per language
    if not sizes:
        return {"families": {}, "machines": {}, "profiles": {}}
    # a language's share of the hash range that gives the expected sample size
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)

    def featurise(it):
        for pdf in it:
            yield pd.DataFrame({"lang": pdf["lang"], "x": [features(t).tobytes() for t in pdf["text"]],
                                "share": [letter_share(t) for t in pdf["text"]]})

    sample = written(labelled.filter(place < share).select("lang", "text").mapInPandas(
        featurise, "lang string, x binary, share double"), "langid-sample")

    def describe(pdf):
        order = np.argsort(pdf["x"], kind="stable")
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf["x"].to_numpy()[order]])
        logs, least, letters = profile(x, pdf["share"].to_numpy())
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "logs": [logs.astype(np.float32).tobytes()],
                             "least": [least], "letters": [letters]})

    described = {}
    if profiles:
        described = {r["lang"]: (np.frombuffer(r["logs"], np.float32), r["least"], r["letters"]) for r in sample.groupBy(
            "lang").applyInPandas(describe, "lang string, logs binary, least double, letters double").collect()}
    of = {lang: families.get(lang, lang) for lang in sizes}
    groups: dict[str, list[str]] = {}
    for lang in sorted(of):
        groups.setdefault(of[lang], []).append(lang)
    names = sorted(groups)
    pairs = [("family", a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    for fam, langs in groups.items():
        pairs += [(fam, a, b) for i, a in enumerate(langs) for b in langs[i + 1:]]
    if not pairs:
        return {"families": groups, "machines": {}, "profiles": described}
    # a row goes to each machine that its language takes part in
    tasks = {lang: [k for k, (kind, a, b) in enumerate(pairs)
                    if (of[lang] if kind == "family" else lang) in (a, b) and kind in ("family", of[lang])]
             for lang in sizes}
    machine = F.array().cast("array<int>")
    for lang, ks in sorted(tasks.items()):
        machine = F.when(F.col("lang") == lang, F.array(*[F.lit(k) for k in ks]).cast("array<int>")).otherwise(machine)

    def train(pdf):
        kind, a, b = pairs[int(pdf["k"].iloc[0])]
        label = pdf["lang"].map(of) if kind == "family" else pdf["lang"]
        order = np.argsort(pdf["x"].to_numpy(), kind="stable")        # the same rows train alike in any order
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf["x"].to_numpy()[order]])
        y = np.where(label.to_numpy()[order] == a, 1.0, -1.0)
        w = train_svm(x, y)
        scale = np.median(np.abs(np.hstack([x, np.ones((len(x), 1))]) @ w)) or 1.0
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "w": [w.astype(np.float32).tobytes()], "scale": [float(scale)]})

    fitted = sample.withColumn("k", F.explode(machine)).groupBy("k").applyInPandas(
        train, "k int, w binary, scale double").collect()
    return {"families": groups, "profiles": described,
            "machines": {pairs[r["k"]]: (np.frombuffer(r["w"], np.float32), r["scale"]) for r in fitted}}


def _vote(x: np.ndarray, kind: str, classes: list[str], machines: dict):
    """One versus one: (index of the winner, confidence 0 to 1) per row."""
    if len(classes) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    total = np.zeros((len(x), len(classes)))
    for i, a in enumerate(classes):
        for j in range(i + 1, len(classes)):
            w, scale = machines[kind, a, classes[j]]
            p = 1.0 / (1.0 + np.exp(-4.0 * np.clip((x @ w[:-1] + w[-1]) / scale, -8, 8)))
            total[:, i] += p
            total[:, j] += 1.0 - p
    total /= len(classes) - 1
    best = total.argmax(axis=1)
    return best, total[np.arange(len(x)), best]


def classify(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of feature rows."""
    names = sorted(model["families"])
    fam, sure = _vote(x, "family", names, model["machines"])
    lang, score = np.empty(len(x), object), np.zeros(len(x))
    for k, name in enumerate(names):
        at = np.flatnonzero(fam == k)
        if len(at):
            best, inner = _vote(x[at], name, model["families"][name], model["machines"])
            lang[at] = np.array(model["families"][name], object)[best]
            score[at] = np.minimum(sure[at], inner)
    return lang, score


def predict(docs: DataFrame, model: dict, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row (and ``keep`` columns)."""
    rows = with_columns_of(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", (fold() == 2).alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), "text")

    def run(it):
        for pdf in it:
            lang, score = np.full(len(pdf), UND, object), np.zeros(len(pdf))
            at = np.flatnonzero(pdf["has_letter"].to_numpy()) if model["families"] else []
            texts = pdf["text"].to_numpy()
            for i in range(0, len(at), 512):
                part = at[i:i + 512]
                lang[part], score[part] = classify(np.stack([features(texts[k]) for k in part]), model)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": lang, "score": score})

    return rows.mapInPandas(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, families: dict[str, str] | None = None, per_language: int = 400) -> DataFrame:
    return predict(docs, fit(docs, families, per_language))


def recognised(x: np.ndarray, share: np.ndarray, model: dict, min_score: float = 0.5) -> np.ndarray:
    """Whether each text is in the language predicted for it: the vote's score
    and the bounds of the language's profile."""
    lang, score = classify(x, model)
    ok = score >= min_score
    for name in set(lang):
        at = np.flatnonzero(lang == name)
        if name not in model["profiles"]:       # the sample missed a rare language
            continue
        logs, least, letters = model["profiles"][name]
        ok[at] &= ((x[at].astype(np.float64) ** 2) @ logs >= least) & (share[at] >= letters)
    return ok


def with_language(docs: DataFrame, min_score: float = 0.5, families: dict[str, str] | None = None,
                  per_language: int = 400) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: they hold a letter,
    the score is at least ``min_score`` (0.5 rejects nothing), and likelihood
    and share of letters reach the predicted language's bounds.  Columns are
    those of ``docs``."""
    model = fit(docs, families, per_language, profiles=True)
    texts = docs["text"].cast("string") if "text" in docs.columns else F.lit(None).cast("string")

    @F.pandas_udf("boolean")
    def accepted(col: pd.Series) -> pd.Series:
        release_memory()
        out = np.zeros(len(col), bool)
        if model["families"]:
            values = col.to_numpy()
            for i in range(0, len(col), 512):
                part = values[i:i + 512]
                x, share = np.stack([features(t) for t in part]), np.array([letter_share(t) for t in part])
                out[i:i + 512] = recognised(x, share, model, min_score)
        return pd.Series(out)

    return docs.filter(texts.isNotNull() & texts.rlike(r"\p{L}")).filter(accepted(texts))
