"""Operators of a training-data pipeline. Nothing else in the library imports this.

What runs inside tasks is shipped with its code, so that executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
