"""Evidence-grounded document analysis and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions and sources that go to the workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
