"""storyloom — narrative analytics as Spark DataFrame plans.

Kernels that run in Python workers (the pair kernel, model callers) are
shipped by value, so executors do not need this package installed.
"""

import sys as _sys

try:  # PySpark vendors cloudpickle
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older PySpark
    pass

__version__ = "0.1.0"
