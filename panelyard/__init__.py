"""Walk-forward allocation analytics over large (asset, month) panels, on Spark."""

import sys

from pyspark import cloudpickle

# Grouped functions travel to executors by value, so no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
