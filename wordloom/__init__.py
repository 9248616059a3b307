"""Text corpus to word embeddings as Spark DataFrame operations.

Every public operator is a plain function from DataFrame to DataFrame (or from
Column to Column), so the pieces can be used alone or chained in one lazy plan.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
