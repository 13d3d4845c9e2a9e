"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Code that runs in tasks is pickled by value, so executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
