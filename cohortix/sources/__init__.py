"""Table access, fixture bindings, spines and sinks."""
from .tables import Tables
from .query import query_to_table, coerce_types, use_database, random_peek
from .spines import month_spine, day_spine, hour_spine, period_table
from .sinks import Bundle, MonthTable, write_csv, write_bundle, save_table
from .shared import new_folder, shared_root

__all__ = [n for n in dir() if not n.startswith("_")]
