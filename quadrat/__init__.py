"""quadrat: tabular statistics and classification as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the few Arrow UDFs by value: executors then need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
