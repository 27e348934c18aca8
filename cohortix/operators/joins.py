"""Join-shaped operators.

period_offset   JOI-7/8   same entity's values N months later, as a left
                          join with zero fill -- planned as one range window
                          over a month index instead of a self-join.
hour_split      JOI-17    state intervals split over clock hours by
                          exploding the (bounded) hour list of each interval,
                          replacing an interval-overlap nested-loop join.
latest_rows     JOI-9     the rows of a key's latest time, ties kept: the
                          latest time is hash-aggregated, rows are filtered by it.
natural_merge   JOI-3     equi-join on all shared columns in which null keys
                          match null keys, spread over salts.
unmatched       JOI-20    anti join.
hierarchy       JOI-10    entity -> parent -> grandparent chain, by month when
                          the entities are monthly snapshots.
asof_lookup     JOI-16    values and running sums of the last row at or before a
                          probe's time: one window per key over rows and probes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _month_index(c):
    return F.year(c) * 12 + F.month(c)


def period_offset(df: DataFrame, keys: list[str], time_col: str, measures: list[str],
                  months: int = 12, suffix: str = "_12", fill: float | None = 0.0,
                  attrs: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (unique on keys + time_col, time_col a month/quarter
    start) with ``m + suffix`` = the same keys' ``m`` exactly ``months``
    later; a missing future row gives ``fill``.

    Planned as one window per key ordered by a month index with the frame
    ``RANGE BETWEEN months FOLLOWING AND months FOLLOWING``: the frame holds
    the single row ``months`` later or nothing, so gaps are handled exactly
    (unlike ``lead``) and the input is read once (unlike a self-join).  A
    key's partition holds one row per period, bounded by the calendar.
    ``attrs`` is accepted for call compatibility (all columns are kept).
    """
    w = Window.partitionBy(*keys).orderBy(_month_index(F.col(time_col))).rangeBetween(months, months)
    out = df
    cols = []
    for m in measures:
        v = F.first(F.col(m)).over(w)
        cols.append((F.coalesce(v, F.lit(fill)) if fill is not None else v).alias(m + suffix))
    return out.select("*", *cols)


def period_lookback(df: DataFrame, keys: list[str], time_col: str, cols: list[str],
                    months: int, suffix: str = "_ly") -> DataFrame:
    """Inner-join form: rows that have a row of the same keys exactly
    ``months`` earlier, with that row's ``cols`` as ``c + suffix`` (one
    range window, no self-join)."""
    w = (Window.partitionBy(*keys).orderBy(_month_index(F.col(time_col)))
         .rangeBetween(-months, -months))
    out = df.select("*", F.first(F.lit(1)).over(w).alias("_has"),
                    *[F.first(F.col(c)).over(w).alias(c + suffix) for c in cols])
    return out.filter(F.col("_has").isNotNull()).drop("_has")


def latest_rows(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """All rows of each key's greatest ``order_col``: ties are kept (a caller that
    needs one row brings keys that are unique with the order).

    The greatest order is a fixed-width buffer, so it is hash-aggregated with a
    map-side step; the rows then meet it by (keys, order), an equi-join that AQE
    broadcasts or splits, and no key's rows are sorted or gathered.  Null keys
    match themselves; rows with a null order count only where nothing else is."""
    top = df.groupBy(*keys).agg(F.max(order_col).alias("_top"))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    on.append(F.col(f"d.{order_col}").eqNullSafe(F.col("t._top")))
    return df.alias("d").join(top.alias("t"), on, "left_semi")


def natural_merge(left: DataFrame, right: DataFrame, how: str = "left", salts: int = 32) -> DataFrame:
    """Join on all shared column names; a null key matches a null key.

    The null key is the hot one (rows whose attribute is unknown), so left rows
    with a null in any key are dealt over ``salts`` by a hash of the whole row and
    right rows with one are copied to each salt.  ``how``: 'left' or 'inner'."""
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no shared column")
    def unknown(names):
        out = F.lit(False)
        for c in names:
            out = out | F.col(c).isNull()
        return out
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    a = left.withColumn("_salt", F.when(unknown(keys), spread).otherwise(0))
    copies = F.when(unknown(keys), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.withColumn("_salt", F.explode(copies))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys] + [F.col("a._salt") == F.col("b._salt")]
    more = [c for c in right.columns if c not in keys]
    return a.alias("a").join(b.alias("b"), on, how).select(*[F.col(f"a.{c}").alias(c) for c in left.columns],
                                                           *[F.col(f"b.{c}").alias(c) for c in more])


def unmatched(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def hierarchy(entities: DataFrame, key: str, parent: str, time_col: str | None = None,
              levels: int = 2, links: DataFrame | None = None) -> DataFrame:
    """Add ``parent_1..parent_levels`` by repeated joins (key -> parent),
    matching on ``time_col`` too when given (monthly snapshots).  ``links``: the
    entities that are a parent of any (all ``entities``, if not given); ``entities``
    then need no key of their own."""
    keys = [time_col] if time_col else []
    link = (entities if links is None else links).select(*keys, F.col(key).alias("_k"), F.col(parent).alias("_p"))
    out = entities.withColumn("parent_1", F.col(parent))
    for i in range(2, levels + 1):
        j = link.withColumnRenamed("_k", f"parent_{i-1}").withColumnRenamed("_p", f"parent_{i}")
        out = out.join(j, [f"parent_{i-1}"] + keys, "left")
    return out


def asof_lookup(probes: DataFrame, rows: DataFrame, keys: list[str], time_col: str, values: list[str],
                running: list[str] = ()) -> DataFrame:
    """Every probe with the ``values`` of the last row of its keys at or before
    its time (null without one), that row's time as ``row_<time>``, and for the
    ``running`` columns ``cum_<c>``, their sum over all rows up to it.

    rows: unique on keys + time.  Rows and probes are put in one sorted stream per
    key (rows first on equal times), so sparse rows need no grid and a key is
    shuffled once; the window streams, whatever stretch of time lies between."""
    mine = [c for c in probes.columns if c not in (*keys, time_col)]
    at = F.struct(F.col(time_col).alias("t"), *[F.col(c) for c in values])
    a = rows.select(*keys, time_col, F.lit(0).alias("_probe"), at.alias("_row"), *[F.col(c).alias(f"_r_{c}") for c in running],
                    F.lit(None).alias("_mine"))
    b = probes.select(*keys, time_col, F.lit(1).alias("_probe"), F.lit(None).alias("_row"),
                      *[F.lit(None).alias(f"_r_{c}") for c in running], F.struct(*mine).alias("_mine"))
    return asof_stream(a.unionByName(b), keys, time_col, values, running)


def asof_stream(both: DataFrame, keys: list[str], time_col: str, values: list[str], running: list[str] = ()) -> DataFrame:
    """``asof_lookup`` on rows and probes that already stand in one frame: keys,
    time, _probe (0 or 1), _row (a row's time t and values, null in probes),
    _r_<c> of the running columns (null in probes) and _mine (a probe's columns)."""
    w = Window.partitionBy(*keys).orderBy(time_col, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(
        *keys, time_col, "_probe", "_mine", F.last("_row", ignorenulls=True).over(w).alias("_row"),
        *[F.sum(f"_r_{c}").over(w).alias(f"cum_{c}") for c in running])
    return both.filter("_probe = 1").select(
        *keys, time_col, "_mine.*", F.col("_row.t").alias(f"row_{time_col}"), *[F.col(f"_row.{c}").alias(c) for c in values],
        *[f"cum_{c}" for c in running])


def hour_split(states: DataFrame, start_col: str = "start_ts", seconds_col: str = "seconds",
               hour_col: str = "hour", out_col: str = "seconds_in_hour") -> DataFrame:
    """One row per (interval, touched clock hour) with the overlap seconds
    ``min(end, hour+1h) - max(start, hour)`` counted on whole-second
    boundaries.  An interval ending exactly on
    an hour boundary also touches that hour with 0 seconds (the warehouse
    range-join form includes the end hour)."""
    start = F.col(start_col)
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(seconds_col).cast("decimal(18,6)"))
    first_h = F.date_trunc("hour", start)
    last_h = F.date_trunc("hour", end)
    exploded = states.withColumn("_end", end).withColumn(
        hour_col, F.explode(F.sequence(first_h, last_h, F.expr("INTERVAL 1 HOUR"))))
    h = F.col(hour_col)
    next_h = h + F.expr("INTERVAL 1 HOUR")
    lo = F.greatest(start, h)
    hi = F.least(F.col("_end"), next_h)

    def whole_seconds(ts):
        # seconds counted on second boundaries (sub-second parts truncated),
        # from the wall-clock fields: no time-zone conversion is involved
        return (F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600
                + F.minute(ts) * 60 + F.floor(F.second(ts)))
    secs = whole_seconds(hi) - whole_seconds(lo)
    return exploded.withColumn(out_col, secs.cast("long")).drop("_end")
