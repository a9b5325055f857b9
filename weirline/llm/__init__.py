"""Operators for preparing training data, and their queries."""

import sys

from pyspark import cloudpickle

# Tasks get this code with the plan, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
