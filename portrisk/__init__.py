"""Portfolio risk analytics as Spark jobs.

Worker-side helpers (tree scoring, the allocation solve) are pickled by value,
so a cluster needs no copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
