"""Help-desk analytics and personal-data redaction on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job; executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
