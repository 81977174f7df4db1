"""Operators for large-scale training-data pipelines; nothing else in textloom imports this subpackage.

Functions of this package that run on executors are pickled by value, so executors need only
Python and its public libraries, not a copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
