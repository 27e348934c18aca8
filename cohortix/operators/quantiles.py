"""Exact quantiles by radix selection, and mergeable quantile sketches.

``exact_quantiles`` finds the values at given ranks without sorting a group.
A value is encoded as a 64-bit whole number of the same order (``order_key``).
Counting starts at the values (with their repeats), is added up to prefixes of 43
bits and from these to prefixes of 22 bits.  Going back down, a rank picks one
prefix of 22 bits, inside it one of 43 bits, inside it one value.  Every window
on that way runs over the prefixes below one prefix, at most ``2 ** STEP`` rows,
wherever the values lie: one far outlier takes a prefix of its own and leaves the
others as fine as they were.  Hot values are one row with a count, and a single
global group needs no single task.

``quantile_sketches`` keeps per group a mergeable summary in a table column, from
which coarser groups are answered without a rescan of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STEP = 21           # bits that a window tells apart
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def order_key(v: Column) -> Column:
    """The bits of a double as a bigint that compares as the doubles do (NaN
    last, both zeros equal).  All steps are exact: a power of two is divided
    out, its exponent corrected where the logarithm is rounded across it."""
    v = v + F.lit(0.0)      # -0.0 becomes 0.0
    a = F.abs(v)
    infinite, normal = a == float("inf"), a >= 2.0 ** -1022
    s = F.when(normal & ~infinite & ~F.isnan(v), a).otherwise(1.0)
    two = lambda e: F.pow(F.lit(2.0), e)
    e = F.floor(F.log2(s))
    e = F.when(two(e) > s, e - 1).when(two(e + 1) <= s, e + 1).otherwise(e)
    bits = (e + 1023) * (1 << 52) + ((s / two(e) - 1) * 2.0 ** 52).cast("bigint")
    small = F.when(normal, 0.0).otherwise(a) * 2.0 ** 537 * 2.0 ** 537
    bits = F.when(infinite, F.lit(2047 << 52)).when(normal, bits).otherwise(small.cast("bigint"))
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v < 0, -bits - 1).otherwise(bits)


def _same(keys: list[str], a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def _below(counts: DataFrame, picked: DataFrame | None, keys: list[str], prefix: str, above: str | None) -> DataFrame:
    """The row of ``counts`` (keys, ``prefix``, _c) that each pick (keys, ``above``,
    _slot, _k: rank inside it) falls into, with the rank left inside that row."""
    j = counts.alias("c").join(picked.alias("p"), _same(keys, "c", "p") + [F.col(f"c.{above}") == F.col(f"p.{above}")]).select(
        "c.*", "p._slot", "p._k")
    w = Window.partitionBy(*keys, "_slot").orderBy(prefix)
    j = j.withColumn("_hi", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = (F.col("_k") >= F.col("_hi") - F.col("_c")) & (F.col("_k") < F.col("_hi"))
    return j.filter(at).withColumn("_k", F.col("_k") - F.col("_hi") + F.col("_c")).drop("_hi", "_c")


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float],
                    method: str = "linear") -> DataFrame:
    """Exact quantiles per group (none: of the whole table): 'linear' (numpy default)
    or 'midpoint' (mean of the two neighbouring ranks).  Returns group + one column
    per prob name.  Null values do not count; a group of nulls only has no row."""
    key = list(group)
    kind = dict(df.dtypes)[value]
    h = (df.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    code = F.col("_v").cast("bigint") if kind in _INTEGRAL else order_key(F.col("_v").cast("double"))
    h = h.select(*key, "_v", "_c", code.alias("_p0")).withColumn("_p1", F.shiftright("_p0", STEP))
    l1 = h.groupBy(*key, "_p1").agg(F.sum("_c").alias("_c")).withColumn("_p2", F.shiftright("_p1", STEP))
    l2 = l1.groupBy(*key, "_p2").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*key)
    l2 = l2.withColumns({"_n": F.sum("_c").over(w), "_hi": F.sum("_c").over(
        w.orderBy("_p2").rowsBetween(Window.unboundedPreceding, 0))})
    ranks = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        ranks += [F.struct(F.lit(f"{name}_{side}").alias("s"), k.cast("bigint").alias("k"), (pos - F.floor(pos)).alias("f"))
                  for side, k in ((0, F.floor(pos)), (1, F.ceil(pos)))]
    r = l2.select(*key, "_p2", "_hi", "_c", F.explode(F.array(*ranks)).alias("r"))
    at = (F.col("r.k") >= F.col("_hi") - F.col("_c")) & (F.col("r.k") < F.col("_hi"))
    # the fraction travels in the slot: it depends on the group's size alone
    top = r.filter(at).select(*key, "_p2", F.struct("r.s", "r.f").alias("_slot"), (F.col("r.k") - F.col("_hi") + F.col("_c")).alias("_k"))
    mid = _below(l1, top, key, "_p1", "_p2").select(*key, "_p1", "_slot", "_k")
    low = _below(h, mid, key, "_p0", "_p1")
    slot = F.col("_slot.s")
    g = low.groupBy(*key).agg(
        *[F.max(F.when(slot == f"{n}_{side}", F.col("_v"))).alias(f"_{n}_{side}") for n in probs for side in (0, 1)],
        *[F.max(F.when(slot == f"{n}_0", F.col("_slot.f"))).alias(f"_{n}_f") for n in probs])
    if method == "midpoint":
        return g.select(*key, *[((F.col(f"_{n}_0") + F.col(f"_{n}_1")) / 2).alias(n) for n in probs])
    return g.select(*key, *[
        (F.col(f"_{n}_0") + (F.col(f"_{n}_1") - F.col(f"_{n}_0")) * F.col(f"_{n}_f")).alias(n) for n in probs])


def rank_error(k: int) -> float:
    """Rank error of a sketch of size ``k`` as a share of the count, that 99 of 100
    answers keep (the published bound of this sketch, fitted to its size)."""
    return 2.296 / k ** 0.9021


def quantile_sketches(df: DataFrame, group: list[str], value: str, k: int = 1024) -> DataFrame:
    """A mergeable summary of ``value`` per group: group, n, sketch (binary, of
    bounded size whatever the count).  Nulls do not count; a group without values
    has none.  Saved as a table, it answers coarser groups later."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, group: list[str], probs: dict[str, float], k: int = 1024) -> DataFrame:
    """Quantiles of coarser groups from their parts' sketches alone: group, n and a
    column per prob name, each a value whose rank is off by ``rank_error(k)`` of n."""
    m = sketches.groupBy(*group).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    return m.select(*group, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(c) for c, p in probs.items()])
