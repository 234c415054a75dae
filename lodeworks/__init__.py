"""Knowledge-base analytics on Spark DataFrames.

Worker functions are pickled by value, so executors need only Spark, pyarrow
and the third-party libraries, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
