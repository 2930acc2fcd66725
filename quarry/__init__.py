"""Spark-native analytics over document collections and conversations.

Functions that run inside Python workers are pickled by value, so a session whose executors lack this package on their
path can still run every operator.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
