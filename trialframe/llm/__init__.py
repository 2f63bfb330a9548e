"""Training-data operators: filters, deduplication, scoring, extraction and mixing.

The rest of the library never imports this package. Functions of this package that run in Python
workers are shipped by value, so executors need numpy, pyarrow and xxhash but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
