"""Operators for large-scale training-data preparation.

Everything of this kind lives here; nothing else in the library imports it.
``queries`` holds the registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
