"""Sequence and grid analytics for many videos at once, as Spark DataFrame jobs."""
import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
