"""Analytics over semi-structured model output, declared on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
