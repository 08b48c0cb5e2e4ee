"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Functions that run on executors are shipped by value, so a cluster
needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
