"""Dataset recipes, governance and usage analytics as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship this package's functions with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
