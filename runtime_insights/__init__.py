"""Runtime Insights: container runtime-security analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python tasks travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
