"""Spark-native enrichment of short social notes, in batch and in streams."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value, so that executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
