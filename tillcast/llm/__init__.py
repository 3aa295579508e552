"""Training-data operators: numbered operators, their queries and SQL.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries when it is present. Functions that run inside tasks are pickled by
value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
