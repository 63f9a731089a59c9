"""mojiweave: a PySpark-native engine for mixed-language keystroke text.

The package is pickled by value, so executors need no copy of it on their
Python path; only third-party libraries have to be installed there.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
