"""Operators for preparing language-model training data (documents, pages, labels).

Functions of this package that run inside tasks are shipped by value, so executors need
only the third-party libraries (numpy, pyarrow, xxhash, ...), not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
