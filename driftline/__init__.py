"""Spark-native analytics for trajectories of many moving entities."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel whole, so the executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
