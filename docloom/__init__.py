"""Document translation and review over tables of documents, on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected to the driver.
"""

import sys

from pyspark import cloudpickle

# Python stages carry the package's small helpers by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
