"""Operators for preparing training text at scale.

The operators, one module each, written on the DataFrame API.  ``queries.py``
binds each to the test tables under the name ``opN_<name>``.  Nothing outside
this package imports it.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel whole, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
