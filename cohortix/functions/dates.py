"""Calendar helpers.  Every function returns DATE, never TIMESTAMP, so the
results compare equal to date literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_day(c) -> Column:
    return F.to_date(_c(c))


def month_start(c) -> Column:
    return F.trunc(_c(c), "month")


def quarter_start(c) -> Column:
    return F.trunc(_c(c), "quarter")


def quarter_end(c) -> Column:
    return F.date_sub(F.add_months(F.trunc(_c(c), "quarter"), 3), 1)


def is_month_end(c) -> Column:
    return _c(c) == F.last_day(_c(c))


def is_quarter_end(c) -> Column:
    return _c(c) == quarter_end(c)


def is_last_month_of_quarter(c) -> Column:
    """Row falls in the last month of its quarter."""
    return F.last_day(_c(c)) == quarter_end(c)


def yr_mo(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM")


def prev_quarter_start(c) -> Column:
    return F.trunc(F.date_sub(_c(c), 1), "quarter")


def week_start(c) -> Column:
    """Monday-based week start."""
    return F.trunc(_c(c), "week")


def months_between_cal(later, earlier) -> Column:
    """Calendar-month boundaries crossed (warehouse ``DATEDIFF(month, ..)``)."""
    la, ea = _c(later), _c(earlier)
    return (F.year(la) - F.year(ea)) * 12 + (F.month(la) - F.month(ea))


def days_in_month(c) -> Column:
    return F.dayofmonth(F.last_day(_c(c)))
