"""lexicube: text cubes, ranking and summarisation as Spark plans.

Subpackages: ``functions`` (column expressions), ``sources`` (readers, writers,
the line grammar), ``operators`` (DataFrame to DataFrame), ``plans`` (whole
queries and their SQL twins), ``streaming`` (incremental counts).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
