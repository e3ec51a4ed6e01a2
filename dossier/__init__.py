"""Document-release analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
