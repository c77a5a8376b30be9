"""Spark-native analytics over camera observations.

Frames, detections, appearance vectors and tracks are ordinary DataFrames; every
operator is a function from DataFrames to DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
