"""PySpark-native engine for per-sequence representation extraction."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
