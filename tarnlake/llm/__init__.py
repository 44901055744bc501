"""Operations of a training-data pipeline.  Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Its functions travel to the executors with the tasks, which need not have the library installed.
register_pickle_by_value(sys.modules[__name__])
