"""Filling in and evaluating sparse entity-by-feature matrices on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
