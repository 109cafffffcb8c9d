"""Repository-risk analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions inside the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
