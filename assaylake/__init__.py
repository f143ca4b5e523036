"""Variant-effect analytics on Spark: every operator is a function from DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# The numpy kernels travel to the executors with the tasks, so that the package need not be
# installed on every node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
