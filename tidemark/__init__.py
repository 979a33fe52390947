"""Panel time-series analytics as Spark jobs: every series of a panel in one plan."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers are sent with their code, so the package needs to be
# installed where the session is started only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
