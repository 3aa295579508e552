"""tillcast: retail sales analytics and next-day forecasting on Spark.

Every operator is a function from DataFrames to a DataFrame, written with the
DataFrame API so that Catalyst plans it and the work is spread over the
cluster. Column names are parameters (see :class:`tillcast.columns.SalesColumns`).
"""

from tillcast.columns import SalesColumns  # noqa: F401
from tillcast.session import get_spark  # noqa: F401
