"""Set-at-a-time cleaning, retrieval and request assembly for large text tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
