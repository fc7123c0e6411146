"""Operators for preparing training text.  Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Workers get these functions with the task, so they need no copy of this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
