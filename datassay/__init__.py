"""Spark-native dataset readiness engine.

The package ships its own functions by value to the Python workers, so a cluster needs no
``--py-files``: only the driver has to be able to import it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
