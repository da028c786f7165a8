"""Training-data operators: near-duplicates, mixing, token counts, private
data, quality, vector search, packing, repeated passages and URL filters.

Each module holds one operator with its own interface; ``registry`` applies
them to the driver's tables.  Nothing outside this subpackage imports it.

Functions of this package run inside Spark's Python workers.  They travel by
value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
