"""Spark-native code indexing and retrieval: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code along, so the package needs to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
