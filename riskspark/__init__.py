"""riskspark - neighbourhood health-risk analytics on Spark DataFrames.

Every operator takes DataFrames and gives DataFrames back; statistics that are
bounded by the number of *columns* or *levels* (never rows) may reach the driver.
"""

import sys

from pyspark import cloudpickle

# Functions used inside pandas UDFs travel with the task, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
