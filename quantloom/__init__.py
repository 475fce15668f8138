"""Forecast-panel analytics and data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
