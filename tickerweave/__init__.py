"""Market analytics over whole tables of daily bars, news, documents and positions, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
