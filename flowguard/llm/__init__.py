"""Operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this subpackage by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
