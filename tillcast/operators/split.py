"""Time-ordered positional split (R5, R6) without a global sort.

The first ``floor(n * frac)`` lines in (date, tie-break) order are train. Day
counts (one row per day) with prefix counts give each day's first position;
the day that holds the cut is one row, which all lines are compared with as a
scalar, so the lines are not shuffled. Only that day's lines are numbered, again with prefix
counts, so neither the table nor the boundary day sits in one task. Lines
without a date are the last, as missing values sort in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators.joins import with_scalars
from tillcast.operators.ordered import prefix_before
from tillcast.operators.stage import stage

TRAIN_FRACTION = 0.80  # fixed value of the reference


def time_split(df: DataFrame, date: str, order_cols: list[str] | tuple,
               frac: float = TRAIN_FRACTION, out: str = "is_train", address: str | None = None) -> DataFrame:
    """``df`` with ``out``: 1 for the first ``floor(n * frac)`` lines, else 0. With ``address``, a
    column of staged lines that numbers them, the lines of the cut's day are compared with its
    first test line as a scalar too, and no line is moved."""
    days = df.groupBy(date).agg(F.count(F.lit(1)).alias("_day_n"))
    # a missing date is a group of its own, after all days
    days = prefix_before(days.withColumn("_no_date", F.col(date).isNull().cast("int")), ["_no_date", date], "_day_n", (), "_day_before")
    total = days.agg(F.floor(F.sum("_day_n") * F.lit(float(frac))).cast("long").alias("_cut"))
    # one row: the day that the cut falls into, and how many of its lines come before the cut; none when all lines are train
    cut = with_scalars(days, total).where((F.col("_day_before") <= F.col("_cut")) & (F.col("_cut") < F.col("_day_before") + F.col("_day_n")))
    cut = cut.select(F.col(date).alias("_day"), (F.col("_cut") - F.col("_day_before")).alias("_of_day"))
    f = with_scalars(df, stage(cut, "cut"), ["_day", "_of_day"])
    on_cut = F.col("_of_day").isNotNull() & F.col(date).eqNullSafe(F.col("_day"))
    before = F.col("_of_day").isNull() | F.coalesce(F.col(date) < F.col("_day"), F.col(date).isNotNull())
    if address:
        order = [*order_cols, address]
        first_test = prefix_before(f.where(on_cut).select(*order, "_of_day"), order, None, (), "_pos").where(F.col("_pos") == F.col("_of_day"))
        f = with_scalars(f, stage(first_test.select(F.struct(*order).alias("_first_test")), "first-test"), ["_first_test"])
        train = F.when(on_cut, F.struct(*order) < F.col("_first_test")).otherwise(before)
        return f.withColumn(out, train.cast("int")).drop("_day", "_of_day", "_first_test")
    clear = f.where(~on_cut).withColumn(out, before.cast("int"))
    bnd = prefix_before(f.where(on_cut), list(order_cols), None, (), "_pos")
    bnd = bnd.withColumn(out, (F.col("_pos") < F.col("_of_day")).cast("int")).drop("_pos")
    return clear.unionByName(bnd).drop("_day", "_of_day")


def split_bounds(split: DataFrame, date: str, flag: str = "is_train") -> DataFrame:
    """Last train date, first test date, and the two row counts."""
    return split.agg(
        F.max(F.when(F.col(flag) == 1, F.col(date))).alias("last_train_date"),
        F.min(F.when(F.col(flag) == 0, F.col(date))).alias("first_test_date"),
        F.sum(F.col(flag)).cast("long").alias("n_train"),
        F.sum(1 - F.col(flag)).cast("long").alias("n_test"))
