"""barwright: equity-market analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no copy of
# this package and the driver's working folder does not matter.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
