"""skein: training-corpus preparation and evaluation analytics on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, windows, joins and aggregations, so Catalyst plans the
work and results never depend on partitioning or scan order.
"""

import sys as _sys

from skein.session import checkpoint_dir, get_spark

# Functions from this package that run on Python workers (pandas UDFs,
# mapInPandas, applyInPandasWithState) are pickled by value, so executors do
# not need the package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with addPyFile instead
    pass

__all__ = ["get_spark", "checkpoint_dir"]
