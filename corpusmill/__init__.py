"""Analytics over source-code and document corpora as Spark DataFrame plans. Worker functions are shipped by value."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
