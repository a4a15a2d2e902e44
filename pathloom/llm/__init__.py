"""Operators of a training-data pipeline over whole document tables.

Functions of this package that run inside tasks travel with their tasks by value, so a cluster
needs no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
