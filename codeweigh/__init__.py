"""codeweigh: Spark jobs that prepare and score prompt/output code corpora."""

import sys

from pyspark import cloudpickle as _cloudpickle

# Ship this package's functions to executors by value, so Python UDFs work on
# a cluster where the package is not installed.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
