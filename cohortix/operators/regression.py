"""Ordinary least squares from mergeable triangular factors.

Rows become factors where they lie: a task reduces its rows of a segment, batch by
batch, to the triangular factor R of [1, x, y] (QR), a matrix as wide as the model
whatever the number of rows.  Factors of two sets of rows stacked and factored
again are the factor of their union, so they are merged over a first layer of
buckets and then per segment; no cross products are formed and nothing is
subtracted from a large sum.  A factor measures its columns from an origin inside
its own rows (the first one) and carries it; merging moves factors to a common
origin, the fit moves the result back.  So a column that is measured from far away
gives the same slopes, and the rows are read once.

The solve works on one small factor per segment: singular values give the rank,
and a deficient design gets the coefficients and errors of smallest norm in the
columns' own units, as a pseudo-inverse of the design would.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RESULT = ("segment string, term string, coef double, std_err double, t double, p_value double, r2 double, n long, rank int")
FACTOR = "segment string, n long, origin binary, r binary"
RANK_TOLERANCE = 1e-10      # of a singular value against the largest, columns of length 1
LAYER = 64          # buckets of the first merge of a segment's factors


def stack(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The factor of the rows of both, zero rows below a short one."""
    r = np.linalg.qr(b if a is None else np.vstack([a, b]), mode="r")
    k = b.shape[1]
    return r if len(r) == k else np.vstack([r, np.zeros((k - len(r), k))])


def moved(r: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The factor of [1, c - by] from that of [1, c]."""
    out = r.copy()
    out[:, 1:] -= np.outer(r[:, 0], by)
    return out


def solve(r: np.ndarray, n: int, at: list[int], origin: np.ndarray, add_const: bool):
    """(coef, std_err, rank, r2) of the terms ``at`` from the factor of
    [1 if add_const, x, y], columns measured from ``origin`` (0 for the 1)."""
    y = r[:, -1]
    x = r[:, at]
    size = np.sqrt((x * x).sum(axis=0))
    size[size == 0] = 1.0
    u, s, vt = np.linalg.svd(x / size, full_matrices=False)
    use = s > s.max(initial=0.0) * RANK_TOLERANCE
    rank = int(use.sum())
    # from the origin's coefficients to those of the columns themselves
    back = np.eye(len(at))
    if add_const:
        back[0, 1:] = -origin[at[1:]]
    half = back @ ((vt[use].T / s[use]) / size[:, None])
    beta = half @ (u[:, use].T @ y)
    if add_const:
        beta[0] += origin[-1]
    if rank < len(at):          # the solution of smallest norm: no part in the null space
        null = np.linalg.qr(back @ (vt[~use].T / size[:, None]))[0]
        half, beta = half - null @ (null.T @ half), beta - null @ (null.T @ beta)
    left = y - u[:, use] @ (u[:, use].T @ y)
    rss = float(left @ left)
    centred = r[1:, -1] if add_const else y
    tss = float(centred @ centred)
    dof = n - rank
    sigma = np.sqrt(rss / dof) if dof > 0 else np.nan
    return beta, np.sqrt((half * half).sum(axis=1)) * sigma, rank, (1 - rss / tss if tss > 0 else np.nan)


def ols_fits(df: DataFrame, y: str, xs: list[str], segment: Column, fits: dict[str | None, list[str]],
             total: str | None = None, add_const: bool = True) -> DataFrame:
    """Coefficient tables: segment, term, coef, std_err, t, p_value, r2, n, rank.

    ``fits``: the features by segment, under None those of all others.  ``total``:
    the label of one more fit over all rows.  Rows with a null or NaN y or feature
    are dropped (complete cases over ``xs``); null segments are left out of the
    segments, not of the total."""
    from .stats import t_sf_two_sided
    names = [f"_x{i}" for i in range(len(xs))] + ["_y"]
    d = df.select(segment.cast("string").alias("segment"), *[F.col(c).cast("double").alias(n) for c, n in zip([*xs, y], names)])
    k = len(names) + add_const
    others = {s: f for s, f in fits.items() if s != total}

    def factors(batches):
        held: dict = {}
        for b in batches:
            seg = np.array(b.column("segment").to_pylist(), dtype=object)
            m = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names])
            # complete cases; dropped here, as a filter above a wide projection of
            # features makes the optimiser derive constraints for seconds
            whole = ~np.isnan(m).any(axis=1)
            seg, m = seg[whole], m[whole]
            for s in set(seg.tolist()):
                part = m[seg == s] if s is not None else m[[v is None for v in seg]]
                n, origin, r = held.get(s, (0, part[0] if add_const else np.zeros(len(names)), None))
                rows = part - origin
                if add_const:
                    rows = np.column_stack([np.ones(len(rows)), rows])
                held[s] = (n + len(part), origin, stack(r, rows))
        if held:
            n, origin, r = zip(*held.values())
            yield pa.RecordBatch.from_pydict({"segment": pa.array(list(held), pa.string()), "n": pa.array(n, pa.int64()),
                                              "origin": pa.array([x.tobytes() for x in origin], pa.binary()),
                                              "r": pa.array([x.tobytes() for x in r], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        # the origin of the largest part is nearest to the whole
        origin, r = np.frombuffer(pdf["origin"].iloc[int(pdf["n"].to_numpy().argmax())]), None
        for x, o in zip(pdf["r"], pdf["origin"]):
            f = np.frombuffer(x).reshape(k, k)
            r = stack(r, moved(f, origin - np.frombuffer(o)) if add_const else f)
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "n": [int(pdf["n"].sum())], "origin": [origin.tobytes()], "r": [r.tobytes()]})

    parts = d.mapInArrow(factors, FACTOR).withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(LAYER)))
    parts = parts.groupBy("segment", "bucket").applyInPandas(merge, FACTOR)
    if total is not None:
        copies = F.array(F.struct(F.col("segment").alias("s"), F.lit(False).alias("t")), F.struct(F.lit(total).alias("s"), F.lit(True).alias("t")))
        parts = parts.select(F.explode(copies).alias("c"), "n", "origin", "r").select(
            F.col("c.s").alias("segment"), F.col("c.t").alias("is_total"), "n", "origin", "r")
    else:
        parts = parts.withColumn("is_total", F.lit(False))
    parts = parts.filter("segment is not null")
    place = {x: i + add_const for i, x in enumerate(xs)}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = merge(pdf).iloc[0]
        label = pdf["segment"].iloc[0]
        terms = fits[total] if pdf["is_total"].iloc[0] else others.get(label, fits.get(None, xs))
        at = ([0] if add_const else []) + [place[x] for x in terms]
        n = int(m["n"])
        beta, se, rank, r2 = solve(np.frombuffer(m["r"]).reshape(k, k), n, at, np.frombuffer(m["origin"]) if not add_const else
                                    np.concatenate([[0.0], np.frombuffer(m["origin"])]), add_const)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = beta / se
        return pd.DataFrame({"segment": label, "term": (["const"] if add_const else []) + list(terms), "coef": beta, "std_err": se, "t": t,
                             "p_value": t_sf_two_sided(t, np.full(len(at), n - rank)), "r2": r2, "n": n, "rank": rank})

    return parts.groupBy("segment", "is_total").applyInPandas(fit, RESULT)
