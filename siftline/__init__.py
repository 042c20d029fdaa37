"""Listing matching, scoring and ranking as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the package's UDFs by value, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
