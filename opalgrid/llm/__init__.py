"""Operators for preparing training corpora.  Nothing outside this subpackage imports it."""

from pyspark.cloudpickle import cloudpickle

import opalgrid

# Worker processes may not have the package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(opalgrid)
