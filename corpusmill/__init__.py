"""corpusmill: retrieval-corpus analytics as plain Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

from corpusmill.session import get_session

# Python functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
