"""Drift-aware analytics over windows of tabular data, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run inside tasks travel with the task, so executors
# do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
