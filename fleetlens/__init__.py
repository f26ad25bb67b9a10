"""fleetlens: PySpark operators over the records a fleet of cooperating machines leaves behind."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
