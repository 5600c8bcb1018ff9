"""Company records to a searchable corpus, and questions to answers, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code with them, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
