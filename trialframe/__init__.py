"""trialframe: Spark-native operators for execution-graded fine-tuning data and model evaluation."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
