"""Document-extraction analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; none runs an action on the
caller's data except the streaming sinks, which own their query.
"""

import sys

from pyspark import cloudpickle

# the few Python functions travel to executors inside the job, so workers need no
# installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
