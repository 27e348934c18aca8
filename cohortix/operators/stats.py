"""Statistics on Spark.

The heavy part -- sums, counts, quantiles, factors of regressions -- runs on
executors.  Only result-sized arrays (one row per slice) reach numpy after that,
inside vectorised functions.

ttest_from_groups  AGG-26  pooled two-sample t-test from per-group n/mean/var
t_two_sided_p              vectorised Student-t tail (regularised incomplete
                           beta by continued fraction; scipy is not needed)
ols_by             AGG-27  OLS with intercept per segment from triangular
                           factors (``regression``); rank reported
corr_matrix        AGG-25  Pearson r of every numeric pair in one aggregate
describe           AGG-24  count/mean/std/min/quartiles/max in one aggregate
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .quantiles import exact_quantiles
from .regression import ols_fits


# ----------------------------------------------------------------- t tails
def _betacf(a, b, x, iters=300, eps=1e-15):
    """Continued fraction of the incomplete beta (modified Lentz), vectorised."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        de = d * c
        h = h * de
        if np.all(np.abs(de - 1.0) < eps):
            break
    return h


def betainc_reg(a, b, x):
    """Regularised incomplete beta I_x(a, b) for arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lbeta = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(am, bm)])
        front = np.exp(lbeta + am * np.log(xm) + bm * np.log1p(-xm))
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = front[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        if (~direct).any():
            r = ~direct
            res[r] = 1.0 - front[r] * _betacf(bm[r], am[r], 1.0 - xm[r]) / bm[r]
        out[mid] = res
    return out


def t_sf_two_sided(t, dof):
    """P(|T| >= |t|) for Student t with ``dof`` degrees of freedom."""
    t = np.asarray(t, dtype=float)
    dof = np.asarray(dof, dtype=float)
    x = dof / (dof + t * t)
    return betainc_reg(dof / 2.0, 0.5, x)


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Vectorised (Arrow-batched) two-sided p-value."""
    return pd.Series(t_sf_two_sided(t.to_numpy(dtype=float, na_value=np.nan),
                                     dof.to_numpy(dtype=float, na_value=np.nan)))


def pooled_t(n1, m1, v1, n2, m2, v2) -> Column:
    """Student t with pooled variance (equal variances), as Column."""
    dof = n1 + n2 - 2
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
    return F.try_divide(m1 - m2, F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n2)))


# ----------------------------------------------------------------- OLS
def ols_by(df: DataFrame, y: str, xs: list[str], by: str | None = None,
           add_const: bool = True) -> DataFrame:
    """Coefficient table per segment (without ``by``: one, 'all'): segment, term,
    coef, std_err, t, p_value, r2, n, rank.  Complete cases only."""
    if by is None:
        return ols_fits(df, y, xs, F.lit(None), {"all": list(xs)}, "all", add_const)
    return ols_fits(df, y, xs, F.col(by), {None: list(xs)}, None, add_const)


def ols_segments(df: DataFrame, y: str, total_xs: list[str], by: str, by_xs: list[str],
                 total_label: str = "all", add_const: bool = True) -> DataFrame:
    """OLS for the whole population (features ``total_xs``) and for each value of
    ``by`` (features ``by_xs``) from a single pass: the factors of the segments
    stacked are the factor of the population, and a fit takes the columns of its
    features.  Complete cases over the union of features."""
    every = list(total_xs) + [x for x in by_xs if x not in total_xs]
    return ols_fits(df, y, every, F.col(by), {total_label: list(total_xs), None: list(by_xs)}, total_label, add_const)


# ----------------------------------------------------------- describe/corr
def corr_matrix(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Pearson r for every pair (pairwise complete), long form: x, y, r.
    A constant column gives null (not NaN)."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    fix = lambda c: F.when(F.isnan(c), F.lit(None)).otherwise(c)
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                                         F.round(fix(F.col(f"{i}")), digits).alias("r"))
                                for i, (a, b) in enumerate(pairs)]))
    return row.select(stack.alias("s")).select("s.*")


def describe(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Per column: count, mean, sample std, min, exact 25/50/75 percentiles
    (linear interpolation), max.  The columns are unpivoted to (column,
    value) once; moments come from one aggregation and the quartiles from
    the histogram quantiles."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("u")).select("u.*")
    mom = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    j = mom.join(q, "column", "left")
    rd = lambda c: F.round(F.col(c), digits).alias(c)
    return j.select("column", "count", rd("mean"), rd("std"), rd("min"), rd("p25"), rd("p50"),
                    rd("p75"), rd("max"))


# ----------------------------------------------------------- outlier fences
def iqr_flags(df: DataFrame, col: str, k: float = 1.5, by: list[str] | None = None) -> DataFrame:
    """FLT-15: Tukey fences from midpoint quartiles; adds ``q1``, ``q3``,
    ``is_upper_outlier`` (>= q3 + k IQR) and ``is_lower_outlier``
    (<= q1 - k IQR).  Filter on the flags to drop outliers."""
    by = by or []
    q = exact_quantiles(df, by, col, {"q1": 0.25, "q3": 0.75}, method="midpoint")
    if by:
        j = df.join(q, by, "left")
    else:       # two values for the whole table
        j = df.withColumns({"q1": q.select("q1").scalar(), "q3": q.select("q3").scalar()})
    iqr = F.col("q3") - F.col("q1")
    return j.withColumns({"is_upper_outlier": F.col(col) >= F.col("q3") + k * iqr,
                          "is_lower_outlier": F.col(col) <= F.col("q1") - k * iqr})
