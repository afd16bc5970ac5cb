"""Operators for preparing training corpora. Nothing outside this package imports it.

Functions that run on executors are pickled by value, so a cluster needs only
the third-party libraries, not this package, on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
