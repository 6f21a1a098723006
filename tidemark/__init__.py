"""tidemark: Spark-native research engine for cross-sectional signals."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, which need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
