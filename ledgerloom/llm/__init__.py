"""Operators for preparing training text: one module per operator.

Functions that run in tasks travel to the workers by value, so executors need numpy,
pyarrow, xxhash and regex, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
