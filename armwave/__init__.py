"""armwave: longitudinal cohort and trial analytics as PySpark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python stages carry their helper functions with them, so workers need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
