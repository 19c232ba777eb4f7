"""Operators for preparing training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
