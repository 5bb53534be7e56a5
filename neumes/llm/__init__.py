"""Operators that prepare a text corpus for language-model training.

Nothing else in the library imports this subpackage. Functions that run on
executors are shipped by value, so that executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
