"""sparkglyph: a PySpark-native engine for interface-association and discrepancy analytics."""

import sys

from pyspark import cloudpickle

# Python functions sent to executors travel with their code, so that executors
# need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
