"""Segregation and unevenness measures over hierarchical counts, on Spark."""

import sys

from pyspark import cloudpickle

from segspark.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]

# Functions of this package travel to the workers with their code: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
