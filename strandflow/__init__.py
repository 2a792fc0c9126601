"""strandflow: a Spark-native engine for structural-insertion analytics.

Everything is a DataFrame, SQL expression or Arrow-batched function.  The
package is shipped to Python workers by value, so that executors need no copy
of it on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
