"""Operators for preparing training data: scoring, filtering, deduplication, mixing, tokens, search."""

import sys

from pyspark import cloudpickle

# What runs in Python workers, which need not have this package installed, travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
