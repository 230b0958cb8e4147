"""Operators for training-data pipelines, with their queries and SQL."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
