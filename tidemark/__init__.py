"""Point-in-time market research jobs on Spark DataFrames."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so that they run
# there without the package's folder on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
