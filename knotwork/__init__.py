"""knotwork: minimum-edit clustering of graphs on Spark, with DataFrame-first operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
