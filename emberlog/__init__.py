"""Log anomaly analytics as Spark jobs: parse, sessionize, window, fit, score, report."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
