"""graphweft: source trees and their side records as typed Spark tables and an evidence-labelled graph."""

import sys

from pyspark import cloudpickle

# Executors may not have this package installed: ship its functions inside the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
