"""Training-data operators. Nothing else in the library imports this package.

Functions of this package travel to Python workers by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
