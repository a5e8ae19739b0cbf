"""Tandem-mass-spectrum analytics as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python tasks travel with the job, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
