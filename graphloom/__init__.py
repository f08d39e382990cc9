"""graphloom: rule and graph reasoning plus analytics, expressed as Spark DataFrame plans."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Python workers get this package's functions by value, so that a cluster needs no installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
