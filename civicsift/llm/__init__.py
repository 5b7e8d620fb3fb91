"""Operators and queries for preparing training text; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their jobs, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
