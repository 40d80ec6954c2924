"""Road-sensor analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Vector kernels travel to the executors by value, so that the package needs to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
