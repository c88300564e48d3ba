"""kbspark: Spark jobs for a product-manual knowledge base and the
conversations held over it."""

import sys as _sys

try:  # ship UDF code by value so executors need no copy of this package
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
