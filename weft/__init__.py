"""weft: corpus, retrieval and training-data jobs on Spark."""

import sys as _sys

try:  # ship this package's task code by value, so executors need no installed copy of it
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
