"""Analytics over append-only event logs of conversational data, as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their tasks, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
