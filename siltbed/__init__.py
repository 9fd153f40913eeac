"""Bronze-layer landing for Spark: sources, incremental extraction, masking, staged writes, run ledger."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel with the task, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
