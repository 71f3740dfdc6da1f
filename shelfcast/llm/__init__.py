"""Operators for preparing training text at scale, each with a registered query.

Nothing else in the library imports this subpackage. The functions that run inside Spark's
Python workers are shipped by value, with the classes that they name, so executors need no installed
copy of the package. ``SparkContext.broadcast`` pickles by reference: broadcasts hold arrays, dicts,
numbers and bytes alone, and the worker builds its objects from them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
