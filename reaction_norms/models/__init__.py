"""Designs, Gaussian fits and leave-one-out scores.

The few Python functions that run inside tasks are shipped with their code, so that
executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
