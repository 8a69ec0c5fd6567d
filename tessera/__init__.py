"""Tessera: a record-linkage and corpus-processing engine on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the functions that run on them with the task: they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
