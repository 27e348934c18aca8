"""Null, NaN and division rules (pandas/warehouse semantics on Spark).

* ``div0(a, b)``   : 0 when ``b`` is 0, null when either side is null.
* ``safe_div(a,b)``: null when ``b`` is 0 (pandas would give inf/NaN; ANSI
  Spark would raise).
* ``row_sum``      : row-wise sum that skips nulls (pandas ``sum(axis=1)``).
* ``zsum``         : aggregate sum that yields 0 for an all-null group.
* ``ne_or_null``   : ``x != v`` that is True when ``x`` is null.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div0(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def safe_div(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def row_sum(*cols) -> Column:
    return reduce(add, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def zsum(c) -> Column:
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def ne_or_null(c, value) -> Column:
    return ~_c(c).eqNullSafe(F.lit(value))
