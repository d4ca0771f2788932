"""Candlewick: interval-bar analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to tasks carry their code, so workers need no installed copy and
# the driver may run from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
