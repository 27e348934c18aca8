"""Binning and label helpers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cut_right(c, edges, labels) -> Column:
    """Right-closed bins ``(e[i], e[i+1]] -> labels[i]``; values at or below the
    first edge, above the last edge, or null give null (pandas ``cut``)."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(labels) == len(edges) - 1")
    x = _c(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def label_map(c, mapping: dict, default=None) -> Column:
    """Literal lookup (``create_map``); unmapped keys give ``default``."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    out = F.try_element_at(m, _c(c))
    return F.coalesce(out, F.lit(default)) if default is not None else out


def flag_label(flags: dict, sep: str = "+") -> Column:
    """Concatenate the names of the true flags (``{name: column}``)."""
    return F.concat_ws(sep, *[F.when(_c(col), F.lit(name)) for name, col in flags.items()])


def ilike_any(c, patterns) -> Column:
    """Case-insensitive match against any of the SQL patterns."""
    from functools import reduce
    from operator import or_
    return reduce(or_, [_c(c).ilike(p) for p in patterns])
