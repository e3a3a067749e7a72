"""Operators for large-scale training-data pipelines, one module per operator.

Nothing outside this package imports it; ``__spark_entry__.py`` registers the
queries of ``llm.queries`` when the package is present.
"""

import sys

from pyspark import cloudpickle

# The Arrow kernels reach the executors inside the task, so they need no package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
