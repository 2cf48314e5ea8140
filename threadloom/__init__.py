"""Spark-first analytics for collections of online-community text."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers as code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
