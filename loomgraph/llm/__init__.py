"""Training-data operators: packing, scoring, sanitising, deduplication, tokenising.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so they need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
