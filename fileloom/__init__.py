"""fileloom: bulk file-format conversion on Spark DataFrames.

A file is a row, a conversion is a column expression (or an Arrow UDF), a batch
is a DataFrame and an archive is an aggregate.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
