"""Operators of a training-data pipeline; nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel by value, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
