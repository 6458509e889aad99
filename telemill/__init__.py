"""telemill: security-telemetry operators for Apache Spark.

Every operator takes DataFrames (batch or streaming) and returns DataFrames; configuration such as
policies, rules and detector sets is small and is turned into Column expressions when the plan is built.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
