"""Operators for preparing training text, and their registered queries.

Nothing else in the library imports this subpackage.  Its functions travel with
the tasks, so workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
