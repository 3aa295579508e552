"""As-of join (weather by date): each row takes the latest reading at or before its time.

Only the different times of the rows are looked up. They are united with the
readings and cut into blocks of ``width`` seconds; within a block the last reading
is carried forward, and what precedes a block's first reading comes from the
latest reading of the blocks before, found on a table of one row a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.operators.joins import join_checked


def asof_join(rows: DataFrame, readings: DataFrame, time: str, reading_time: str, tie: str, values: list[str], width: int = 7 * 86400) -> DataFrame:
    """``rows`` with ``values`` of the latest reading whose ``reading_time`` is at
    or before ``time``; of several at one time the largest ``tie`` counts. NULL where there is none."""
    r = readings.where(F.col(reading_time).isNotNull()).select(F.col(reading_time).cast("timestamp").alias("_t"), F.col(tie).alias("_tie"), *[F.col(v).alias(f"_v_{v}") for v in values])
    # one reading a time, the largest tie: combined before the shuffle
    read = F.struct("_tie", *[f"_v_{v}" for v in values])
    r = r.groupBy("_t").agg(F.max_by(read, F.col("_tie")).alias("_r"))
    block = F.floor(F.unix_seconds("_t") / width)
    points = rows.where(F.col(time).isNotNull()).select(F.col(time).cast("timestamp").alias("_t")).distinct()
    both = r.select("_t", F.lit(0).alias("_kind"), "_r").unionByName(points.select("_t", F.lit(1).alias("_kind"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r")))
    w = Window.partitionBy("_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("_b", block).withColumn("_own", F.last("_r", ignorenulls=True).over(w)).where("_kind = 1").select("_t", "_b", "_own")
    # one row a block, with or without a reading
    blocks = both.groupBy(block.alias("_b")).agg(F.max_by("_r", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_last"))
    carried = blocks.select("_b", F.last("_last", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    found = own.join(F.broadcast(carried), "_b").select(F.col("_t").alias("_at"), F.coalesce("_own", "_before").alias("_r"))
    out = join_checked(rows, found, F.col(time).cast("timestamp") == F.col("_at"))
    return out.select(*[f"`{c}`" for c in rows.columns], *[F.col(f"_r._v_{v}").alias(v) for v in values])
