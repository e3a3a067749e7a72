"""civictext: multilingual civic text analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions shipped to executors (pandas UDFs, mapInPandas and cogroup
# kernels) are pickled with their code, so the workers need not have this
# package on their path, whatever directory or cluster node they start on.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
