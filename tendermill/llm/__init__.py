"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Functions that run inside Python workers
travel with the plan, so executors need no copy of these files.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
