"""Operators of a training-data pipeline: dedup, filters, formats and tokens over Spark tables.

Functions that run inside Python workers are shipped by value, so the workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
