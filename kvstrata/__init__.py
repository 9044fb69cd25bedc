"""A PySpark engine for versioned, ordered key-value collections.

Functions of this package that run in Python workers are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"


def version() -> str:
    return __version__
