"""Guarded question answering and analytics over Spark tables."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors need
# Spark, numpy and pandas, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from guardedlake.session import get_spark, shared_dir  # noqa: E402

__all__ = ["get_spark", "shared_dir"]
