"""Conversation-export analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run in Python tasks are pickled by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
