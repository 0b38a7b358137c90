"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Its functions travel to executors
by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
