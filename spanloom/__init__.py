"""spanloom: a PySpark engine for finding, repairing, comparing and publishing spans in paginated text."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to the executors with their code, so nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
