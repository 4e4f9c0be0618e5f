"""matquarry: Spark DataFrame operators for data-driven materials search."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that call them, so executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
