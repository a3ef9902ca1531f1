"""recordgauge: Spark-native evaluation of nested, semi-structured records.

Everything is a function from DataFrames to DataFrames (or Columns to Columns).
The package registers itself with cloudpickle so that the few Arrow functions it
ships reach executors by value: a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
