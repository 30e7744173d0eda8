"""Spark-native analytics for labelled prompt corpora.

Every operator takes and returns DataFrames.  Sub-packages: ``sources`` (read
and write), ``functions`` (column expressions), ``operators`` (one module per
family), ``plans`` (compositions), ``streaming`` (the same scoring on
Structured Streaming) and ``catalog`` (the registered queries with their SQL).
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
