"""textloom: Spark-native curation of text datasets for language-model training.

Python functions of the package are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
