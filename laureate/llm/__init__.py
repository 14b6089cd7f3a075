"""Operators for preparing language-model training data."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to Python workers whole, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
