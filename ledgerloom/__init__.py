"""Evidence analytics on Spark: inventories, comparisons, ledgers, graphs and policies as DataFrame plans."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # functions travel to the executors by value: a worker needs no copy of the package
