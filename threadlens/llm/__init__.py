"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage.

The functions that run inside Python tasks are pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
