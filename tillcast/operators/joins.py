"""Joins with a checked broadcast side.

A statistic table is broadcast only when the optimizer's size estimate, which
for a staged table is the size of its Parquet files, is within a budget of
bytes; beyond it the join stays a shuffle join, which AQE may still split when
a key is hot. The result is the same either way. Broadcasting the small side
up front spares the wide fact the shuffle it would otherwise get before AQE
can switch strategies at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of Parquet that one broadcast table may have; a feature plan has about
# a dozen such tables, so all together stay within a few hundred MB.
BROADCAST_MAX_BYTES = 8 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size of the plan (for a scan: of its files); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(small: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``broadcast(small)`` when its estimated size is within the budget."""
    budget = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    return F.broadcast(small) if estimated_bytes(small) <= budget else small


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "left",
                 max_bytes: int | None = None) -> DataFrame:
    return big.join(checked_broadcast(small, max_bytes), on, how)


def with_scalars(df: DataFrame, one_row: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Add columns of a one-row frame (global scalars, weather, forecast-day
    context) to every row through one scalar subquery that returns them as a
    struct: evaluated once, no join. More than one row is an error, none gives NULL."""
    cols = list(cols or one_row.columns)
    row = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("s")).scalar()
    return df.select("*", row.alias("_scalars")).select(*[f"`{c}`" for c in df.columns], *[F.col(f"_scalars.`{c}`").alias(c) for c in cols])
