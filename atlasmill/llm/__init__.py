"""Training-data operators: de-duplication, filtering, mixing, packing, search and archives."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with each job, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
