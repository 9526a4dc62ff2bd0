"""Operators for large training-data pipelines. Functions sent to Python workers travel by value, so that a worker needs
no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
