"""Operators of a training-data pipeline, each a function on DataFrames.

Nothing outside this package imports it.  Functions that run on executors are
pickled by value, so the workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
