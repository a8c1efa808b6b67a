"""Cloud-cost analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame and works on all
tenants at once: ``user_id`` is a grouping key, and every notion of "now" is
an explicit ``as_of`` argument.
"""

import sys

from pyspark import cloudpickle

# Grouped pandas functions of this package travel inside the task closure, so
# executors need no copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
