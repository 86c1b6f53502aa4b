"""Dataset selection on Spark: DataFrame-to-DataFrame operators that decide which rows of a
very large training set are worth keeping."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so a cluster needs no copy of
# this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
