"""Batch analytics on Spark DataFrames: text, relational, graph, ML and run-time models."""

import sys

from pyspark import cloudpickle

# Ship the small vectorised functions to executors that do not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
