"""The corpus pipeline: language ID, exact dedup, near-duplicate join, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's documents.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers

from cohortix.llm import grace_dedup, language_id, ngram_join, packing
from cohortix.llm._util import scratch


def language(spark, docs, sf_dir):
    """Documents whose language is recognised; text without a letter goes."""
    return language_id.with_language(docs)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return grace_dedup.dedup(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each component of linked documents (five words, 0.8)."""
    return ngram_join.one_per_component(docs)


def pack(spark, docs, sf_dir):
    """Sequences of at most 4096 tokens, one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("language_id", language), ("exact_dedup", exact_dedup), ("ngram_join", near_dedup), ("packing", pack)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
