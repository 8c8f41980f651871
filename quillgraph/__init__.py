"""A revisioned knowledge graph over text corpora, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel whole, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
