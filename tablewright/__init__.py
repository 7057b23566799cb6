"""Harmonise, profile, corrupt and compare messy tables with PySpark DataFrames."""

import sys

from pyspark.cloudpickle import cloudpickle

__version__ = "0.1.0"

# helpers used inside Python tasks travel with the task, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
