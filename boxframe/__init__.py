"""boxframe: object-detection data as Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); planning and execution are Spark's.
"""

import sys

from pyspark import cloudpickle

# Python workers get this package's helper functions with the task itself, so a
# job also runs where the package is not installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
