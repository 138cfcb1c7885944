"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage.

Its functions travel to the executors by value: they need no installed copy there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
