"""siltworks: cleaning, profiling and auditing of tabular data on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
