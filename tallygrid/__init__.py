"""Analytics of answer distributions on Spark.

``functions`` holds column builders, ``operators`` the relational and
statistical operators, ``sources`` readers and writers, ``streaming`` the
incremental variants and ``plans`` the named queries over the bound tables.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so executors don't need it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
