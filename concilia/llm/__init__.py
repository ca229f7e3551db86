"""Operators that prepare text corpora for model training.

Functions that run inside tasks are sent to the executors by value, so that a cluster
needs the libraries these modules import, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
