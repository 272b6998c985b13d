"""Operators of a training-data pipeline. Nothing outside this package imports it.

The functions that run inside tasks travel by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
