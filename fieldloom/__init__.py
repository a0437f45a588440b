"""fieldloom: Spark-native profiling and alignment of heterogeneous event data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs no copy
# of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
