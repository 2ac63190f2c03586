"""Subject classification of large document and slide-deck collections on Spark."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
