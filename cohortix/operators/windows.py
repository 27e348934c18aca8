"""Window operators.

All windows here partition by an entity key *after* the data has been
aggregated to (entity, period) grain, so a partition holds at most one row
per period -- bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def trailing(df: DataFrame, keys: list[str], order: str, value: Column, n: int, name: str,
             agg=F.sum) -> DataFrame:
    """``agg(value)`` over the current and ``n - 1`` preceding rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, agg(value).over(w))


def running_sum(df: DataFrame, keys: list[str], order: str, cols: dict[str, str]) -> DataFrame:
    """Cumulative sums ``{out: in}`` from the first row to the current row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for out, src in cols.items():
        df = df.withColumn(out, F.sum(src).over(w))
    return df


def nearest_non_null(df: DataFrame, keys: list[str], order: str, col: str, name: str) -> DataFrame:
    """``coalesce(col, previous non-null, next non-null)`` (LAG/LEAD IGNORE NULLS)."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(col, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(F.col(col), prev, nxt))


def ffill(df: DataFrame, keys: list[str], order: str, col: str, name: str | None = None,
          lead_fill=0.0) -> DataFrame:
    """Forward fill; values before the first non-null become ``lead_fill``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = F.last(col, ignorenulls=True).over(w)
    if lead_fill is not None:
        out = F.coalesce(out, F.lit(lead_fill))
    return df.withColumn(name or col, out)


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """Top-k report rows (the limit is the feature): ``order`` must make the
    ranking total (add tie-breakers) so the result is deterministic.
    Plans as TakeOrderedAndProject (k rows per partition, then a merge)."""
    return df.orderBy(*order).limit(k)
