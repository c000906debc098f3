"""trellis: a PySpark-native engine for searching and curating a media catalogue."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel whole, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
