"""Spark operators that turn hourly observation series and written reports into text corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, with the module functions they call, so a worker needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
