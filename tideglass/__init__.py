"""Tideglass: tick-stream analytics and forensics on Spark DataFrames.

Functions that run in Python workers are sent there as code, so executors
need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
