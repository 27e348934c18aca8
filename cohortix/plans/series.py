"""Series preparation for charts: axis alignment with fills (M53) and
resampling on an interpolating spline of any degree (M54).  Drawing itself is
out of scope."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def align_series(df: DataFrame, x: str, y: str, group: str, mask_outside: bool = True) -> DataFrame:
    """Every group on the common axis (all distinct ``x``, ascending, with
    0-based position ``pos``); missing values forward-filled, leading gaps
    0; with ``mask_outside`` values before the group's first or after its
    last observed x become null.  ``df`` has one row per (group, x).

    The axis is one array row (distinct x values, bounded by the calendar),
    expanded per group with ``posexplode`` -- no pairwise join."""
    axis = df.agg(F.array_sort(F.collect_set(x)).alias("_axis"))      # one row
    span = df.groupBy(group).agg(F.min(x).alias("_first"), F.max(x).alias("_last"))
    grid = span.crossJoin(F.broadcast(axis)).select(group, "_first", "_last",
                                       F.posexplode("_axis").alias("pos", x))
    j = grid.join(df.select(group, x, y), [group, x], "left")
    w = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(y, ignorenulls=True).over(w), F.lit(0.0))
    if mask_outside:
        filled = F.when(F.col(x).between(F.col("_first"), F.col("_last")), filled)
    return j.select(group, x, "pos", filled.alias(y))


def spline_knots(xs: np.ndarray, degree: int) -> np.ndarray:
    """Knots of the interpolating spline on ``xs``: the points themselves (odd
    degree) or their midpoints (even), without the ones next to the ends."""
    cut = (degree + 1) // 2
    inner = xs if degree % 2 else (xs[1:] + xs[:-1]) / 2
    return np.concatenate([np.full(degree + 1, xs[0]), inner[cut:len(inner) - cut], np.full(degree + 1, xs[-1])])


def spline_basis(knots: np.ndarray, degree: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The degree + 1 B-splines that are not zero at each point: the number of
    the first one, and their values."""
    n = len(knots) - degree - 1
    span = np.clip(np.searchsorted(knots, at, side="right") - 1, degree, n - 1)
    out = np.zeros((len(at), degree + 1))
    out[:, 0] = 1.0
    for d in range(1, degree + 1):
        saved = np.zeros(len(at))
        for r in range(d):
            right, left = knots[span + r + 1], knots[span + 1 - d + r]
            part = out[:, r] / (right - left)
            out[:, r] = saved + (right - at) * part
            saved = (at - left) * part
        out[:, d] = saved
    return span - degree, out


def solve_banded(first: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solve for all columns of ``y`` at once: row j of the matrix holds ``rows[j]``
    from column ``first[j]`` on.  Elimination inside the band, without pivots: the
    matrix of B-splines at interpolation points is totally positive."""
    n, k = len(rows), rows.shape[1] - 1
    band = np.zeros((n, 2 * k + 1))
    for c in range(k + 1):
        band[np.arange(n), first + c - np.arange(n) + k] = rows[:, c]
    y = y.astype(float).copy()
    for j in range(n):
        for r in range(1, min(k, n - 1 - j) + 1):
            f = band[j + r, k - r] / band[j, k]
            if f:
                band[j + r, k - r:2 * k + 1 - r] -= f * band[j, k:]
                y[j + r] -= f * y[j]
    for j in range(n - 1, -1, -1):
        m = min(k, n - 1 - j)
        y[j] = (y[j] - band[j, k + 1:k + 1 + m] @ y[j + 1:j + 1 + m]) / band[j, k]
    return y


def spline_eval(xs: np.ndarray, ys: np.ndarray, xn: np.ndarray, degree: int = 3) -> np.ndarray:
    """Values at ``xn`` of the spline through (xs, ys); ``ys`` may hold a column
    per series.  Linear in the number of points."""
    xs = np.asarray(xs, float)
    knots = spline_knots(xs, degree)
    ys = np.asarray(ys, float)
    coef = solve_banded(*spline_basis(knots, degree, xs), ys.reshape(len(xs), -1))
    first, values = spline_basis(knots, degree, np.asarray(xn, float))
    out = sum(values[:, c:c + 1] * coef[first + c] for c in range(degree + 1))
    return out[:, 0] if ys.ndim == 1 else out


def resample_curve(aligned: DataFrame, group: str, pos: str, y: str, factor: int = 20,
                   mask: bool = True, degree: int = 3) -> DataFrame:
    """Per group: the series at ``factor * n - (factor - 1)`` evenly spaced positions
    on the interpolating spline of ``degree``.  Series of up to ``degree`` points are
    returned as they are, under 4 points always.  With ``mask`` the points outside
    the group's observed span (null y in ``aligned``) stay null.

    A group is one array on the bounded axis.  The series of an Arrow batch that
    have the same positions are solved together, each in time linear in its points."""
    gtype = dict(aligned.dtypes)[group]
    point = F.struct(F.col(pos).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    packed = aligned.groupBy(group).agg(F.array_sort(F.collect_list(point)).alias("_points"))

    def fit(batches):
        for pdf in batches:
            alike: dict[bytes, list] = {}
            for key, points in zip(pdf[group], pdf["_points"]):
                xs = np.array([p["x"] for p in points], float)
                raw = np.array([np.nan if p["y"] is None else p["y"] for p in points], float)
                alike.setdefault(xs.tobytes(), []).append((key, raw))
            for xs, series in alike.items():
                xs = np.frombuffer(xs)
                whole = len(xs) < max(4, degree + 1)
                xn = xs if whole else np.linspace(xs.min(), xs.max(), len(xs) * factor - (factor - 1))
                raws = np.column_stack([r for _, r in series])
                yn = raws if whole else spline_eval(xs, np.nan_to_num(raws, nan=0.0), xn, degree)
                for c, (key, raw) in enumerate(series):
                    ok, out = ~np.isnan(raw), yn[:, c]
                    if mask and not whole:
                        lo, hi = (xs[ok].min(), xs[ok].max()) if ok.any() else (np.inf, -np.inf)
                        out = np.where((xn >= lo) & (xn <= hi), out, np.nan)
                    values = pd.Series(out, dtype="Float64").mask(np.isnan(out))
                    yield pd.DataFrame({group: [key] * len(xn), "x": xn, "y": values})

    return packed.mapInPandas(fit, f"{group} {gtype}, x double, y double")
