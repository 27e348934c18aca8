"""cohortix: subscription and operations analytics as Spark DataFrame pipelines.

Layers:
  functions/  column expressions (null, date, bucket rules)
  sources/    table access, fixture bindings, spines and sinks
  operators/  reusable DataFrame -> DataFrame building blocks
  plans/      the metric pipelines
  streaming/  intentionally empty (no stream semantics to reproduce)
"""

import sys as _sys

try:
    # Python functions shipped to executors (pandas UDFs, grouped pandas
    # functions) are pickled by value, so workers need no installed copy of
    # this package and no shared path.
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler: fall back to imports
    pass

__all__ = ["session"]
