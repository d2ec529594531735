"""Training-data operators: encoding, packing, counting, scanning, deduplication, chat formatting, language ID.

Nothing outside this subpackage imports it.  Functions that run in Python workers are pickled by value, so executors
need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
