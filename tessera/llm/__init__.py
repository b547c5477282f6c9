"""Operators for building training corpora: search, filtering, deduplication, tokenisation, packing.

Nothing else in the library imports this subpackage. Its functions run inside Arrow
map functions on executors, so they travel by value: a worker needs numpy and pyarrow, not this
package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
