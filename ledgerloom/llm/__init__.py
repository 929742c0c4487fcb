"""Operators of a training-data pipeline, as Spark jobs.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Its functions travel to the executors by value: a worker needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
