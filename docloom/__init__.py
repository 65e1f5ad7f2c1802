"""Preparing document corpora and evaluating classifiers over them, on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
