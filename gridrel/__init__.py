"""Raster, time-series and spatial-pairing analytics as relations, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value: workers need Spark and numpy, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
