"""Operators of a training-data pipeline; nothing else in the library imports them.

Functions sent to Spark's Python workers are pickled by value, so the workers
need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
