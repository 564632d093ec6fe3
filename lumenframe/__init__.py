"""lumenframe: a Spark-first engine for ranking, grouping and sequencing moments in keyed time series."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The package's own functions travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
