"""PySpark-native analytics for paired recordings and their frame tables.

Layout
------
``functions``   Column builders and vectorised kernels (no plan of their own)
``operators``   DataFrame -> DataFrame building blocks
``sources``     readers, plus the sinks in ``sources.sinks``
``plans``       whole jobs composed from the operators
``streaming``   Structured Streaming twins of the time operators
``catalog``     the registered queries and their SQL oracles
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# UDF code travels with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
