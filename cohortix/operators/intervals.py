"""Validity intervals: states known only by their changes, read at given days.

A source that has a row per change (not per day) answers "what stood on day d"
through intervals: a row holds from its day until the next row of its keys, or
until a day of its own.  Windows run over one entity's changes; reading at
quarter ends explodes an interval into the quarter ends it covers, so no calendar
is joined and an entity without changes in a quarter still shows its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import quarter_end


def validity(changes: DataFrame, keys: list[str], time_col: str, states: list[str], until: Column | None = None,
             join_equal: bool = True) -> DataFrame:
    """keys, states, valid_from, valid_to (exclusive; null: still valid).

    changes: unique on keys + time.  ``until``: a day after which a row holds no
    longer, whatever follows.  Neighbouring intervals of equal states are one with
    ``join_equal`` (two more windows over the same partitioning); an interval of no
    day is left out."""
    w = Window.partitionBy(*keys).orderBy(time_col)
    follow = F.lead(time_col).over(w)
    d = changes.withColumn("_until", until if until is not None else F.lit(None).cast("date"))
    d = d.select(*keys, *states, F.col(time_col).alias("valid_from"), F.least(follow, "_until").alias("valid_to"))
    d = d.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    if not join_equal:
        return d
    v = Window.partitionBy(*keys).orderBy("valid_from")
    state = F.struct(*states)
    joined = F.lag(state).over(v).eqNullSafe(state) & F.lag("valid_to").over(v).eqNullSafe(F.col("valid_from"))
    d = d.withColumn("_new", (~joined).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run")
    open_end = F.max(F.col("valid_to").isNull()).over(run)
    return (d.withColumn("_end", F.when(~open_end, F.max("valid_to").over(run))).filter("_new = 1")
             .select(*keys, *states, "valid_from", F.col("_end").alias("valid_to")))


def at_quarter_ends(intervals: DataFrame, as_of: str, since: str | None = None) -> DataFrame:
    """A row per interval and quarter end that it covers, up to ``as_of``: the
    interval's columns without its ends, and ``dt``, the quarter's last day."""
    end = F.coalesce("valid_to", F.date_add(F.lit(as_of).cast("date"), 1))
    end = F.least(end, F.date_add(F.lit(as_of).cast("date"), 1))
    start = F.trunc("valid_from", "quarter")
    if since:       # no quarter before this day's is asked for
        start = F.greatest(start, F.trunc(F.lit(since).cast("date"), "quarter"))
    last = F.add_months(F.trunc(end, "quarter"), -3)        # of the quarters whose last day lies before the end
    d = intervals.withColumns({"_a": start, "_z": last}).filter("_a <= _z")
    d = d.withColumn("_q", F.explode(F.sequence("_a", "_z", F.expr("INTERVAL 3 MONTH"))))
    return d.withColumn("dt", quarter_end("_q")).drop("_a", "_z", "_q", "valid_from", "valid_to")
