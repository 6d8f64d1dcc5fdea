"""Telemetry and code-corpus analytics as plain PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
