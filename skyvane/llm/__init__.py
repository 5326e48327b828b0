"""Operators of a training-data pipeline over documents, pages and conversations."""

import sys

from pyspark import cloudpickle

# Functions travel to executors with what they use, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
