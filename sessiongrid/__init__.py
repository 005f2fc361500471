"""Analytics for labelled, multi-source session time series, as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with the job, so workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
