"""Spark-native operators for preparing, scoring and judging text guardrail data."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
