"""Text-to-persona analytics on Spark DataFrames.

Subpackages: ``sources`` (read and write), ``functions`` (column expressions),
``operators`` (DataFrame in, DataFrame out), ``plans`` (whole jobs).
"""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so that the package need not
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
