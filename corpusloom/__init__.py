"""Spark-first operators for preparing text/code corpora and analysing API-call evaluations."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
