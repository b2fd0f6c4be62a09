"""Operators for preparing training data: one module per operator.

Nothing else in the library imports this subpackage.  Its functions run inside
Python workers, and a cluster's executors need not have this repository on
their disks, so the whole subpackage is pickled by value with the tasks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
