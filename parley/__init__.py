"""Conversation analytics on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with the job, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
