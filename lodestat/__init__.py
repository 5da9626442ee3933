"""Table analytics for PySpark: every operator takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the package with the functions that run in Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
