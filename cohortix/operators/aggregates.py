"""Aggregation operators.

conditional_distinct  AGG-5   many COUNT(DISTINCT IF(cond, id)) per group,
                              planned as two hash aggregations (per id, then
                              per group) instead of an Expand of the input
                              rows once per distinct-count.
with_total            AGG-15  group rows plus a 'Total' row per outer key.
value_counts          AGG-17  counts and normalised shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def conditional_distinct(df: DataFrame, group: list, id_col: str, conds: dict[str, Column],
                         extra_aggs: list[Column] | None = None) -> DataFrame:
    """``{name: cond}`` -> count of distinct non-null ``id_col`` with cond true."""
    gcols = [g if isinstance(g, Column) else F.col(g) for g in group]
    gnames = [g if isinstance(g, str) else None for g in group]
    if any(n is None for n in gnames):
        raise ValueError("group must be column names; add computed keys with withColumn first")
    per_id = (df.filter(F.col(id_col).isNotNull())
                .groupBy(*gcols, F.col(id_col))
                .agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in conds.items()]))
    return per_id.groupBy(*gnames).agg(*[F.count_if(F.col(n)).alias(n) for n in conds],
                                       *(extra_aggs or []))


def with_total(df: DataFrame, outer: list[str], inner: str, aggs: list[Column],
               total_label: str = "Total") -> DataFrame:
    """Rows per (outer, inner) and a total row per outer, its inner key labelled
    ``total_label``.  ``aggs`` are sums or counts: the input is aggregated once,
    and the totals add up its few result rows."""
    g = df.groupBy(*outer, inner).agg(*aggs)
    values = [c for c in g.columns if c not in (*outer, inner)]
    both = g.withColumn(inner, F.explode(F.array(F.col(inner), F.lit(total_label))))
    return both.groupBy(*outer, inner).agg(*[F.sum(v).alias(v) for v in values])


def value_counts(df: DataFrame, col: str, normalize: bool = True) -> DataFrame:
    c = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return c
    tot = c.agg(F.sum("n").alias("_t"))   # keyless aggregate: one row
    return c.crossJoin(F.broadcast(tot)).withColumn("share", F.round(F.col("n") / F.col("_t"), 6)).drop("_t")
