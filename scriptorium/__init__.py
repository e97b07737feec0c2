"""scriptorium: a captured web site or document collection as a searchable, linked corpus, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
