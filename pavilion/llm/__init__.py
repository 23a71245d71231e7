"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
