"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.cloudpickle import cloudpickle

import opalgrid
from opalgrid.plans import rasters, regions

# Worker processes may not have the package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(opalgrid)


def queries() -> dict:
    return {f.__name__: f for f in (*rasters.QUERIES, *regions.QUERIES)}


def oracle_sql() -> dict:
    return rasters.SQL | regions.SQL
