"""Lectern: course-corpus preparation, retrieval and conversation analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the plan, so a job needs no separate
# copy of this package on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
