"""Joins that split measured heavy keys (J1 with duplicated masters).

A key is heavy when its rows are more than an even share of the tasks, so there are
fewer heavy keys than tasks. Their rows are dealt to so many parts that each
is about one share, and the other side's rows of these keys are copied to each
part; all other keys are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators.joins import with_scalars
from tillcast.operators.stage import stage


def heavy_keys(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows (key, _split): keys with more than 1 / ``parts`` of all rows (by
    default the session's shuffle partitions) and how many shares they make up."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    share = df.agg((F.count(F.lit(1)) / F.lit(parts)).alias("_share"))
    return with_scalars(counts, share).where("_n > _share").select(key, F.ceil(F.col("_n") / F.col("_share")).cast("int").alias("_split"))


def split_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", parts: int | None = None) -> DataFrame:
    """``big`` joined with ``small`` on ``key`` (inner or left), as ``big.join(small, key, how)``."""
    if how not in ("inner", "left"):
        raise ValueError("only rows of the first side are split: inner or left")
    heavy = F.broadcast(stage(heavy_keys(big, key, parts), "heavy-keys"))  # fewer rows than ``parts``
    row = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns], F.monotonically_increasing_id())
    left = big.join(heavy, key, "left").withColumn("_salt", F.coalesce(F.pmod(row, F.col("_split")), F.lit(0)).cast("int")).drop("_split")
    right = small.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_split", F.lit(1)) - 1))).drop("_split")
    return left.join(right, [key, "_salt"], how).drop("_salt")
