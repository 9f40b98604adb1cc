"""Arbora: structural similarity analytics over forests of trees, on PySpark."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
