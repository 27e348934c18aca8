"""Column-expression helpers (pure Catalyst expressions, no UDFs)."""
from .nulls import div0, safe_div, row_sum, ne_or_null, zsum
from .dates import (month_start, quarter_start, quarter_end, is_month_end,
                    is_quarter_end, is_last_month_of_quarter, yr_mo, prev_quarter_start,
                    week_start, months_between_cal, days_in_month,
                    to_day)
from .buckets import cut_right, label_map, flag_label, ilike_any

__all__ = [n for n in dir() if not n.startswith("_")]
