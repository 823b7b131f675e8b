"""Governance analytics as Spark DataFrame operators.

Sub-packages
------------
rules       fixed rule tables (prompt patterns, policies, keyword lists, ...)
functions   column expressions: text, hashing, statistics, vectors
operators   DataFrame -> DataFrame operators, one module per family
sources     readers, writers and generators
plans       composed pipelines (impact report, legal change analysis, ...)
streaming   Structured Streaming versions of the stateful operators
catalog     the named queries and their SQL cross-checks
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors inside the task, so
# the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
