"""Encodings fitted on the train side only.

The original's target encodings use all lines, the test lines' own values among
them. Here the split comes first. A test line gets its material's smoothed
mean over the train lines; a train line gets the mean of the train lines of
earlier days only, from prefix sums over a table of one row a material and
day, so that no line's value is in its own encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.operators import stats
from tillcast.operators.joins import join_checked, with_scalars
from tillcast.operators.split import time_split
from tillcast.operators.stage import stage
from tillcast.plans.features import ALPHA_MAT, FeaturePlan
from tillcast.plans.forecast import regression_metrics


def train_side_encoding(fp: FeaturePlan, alpha: float = ALPHA_MAT) -> DataFrame:
    """All lines with ``is_train`` and ``TE_Train_Mat``."""
    c = fp.cols
    lines = time_split(fp.base, c.date, c.order)
    train = lines.where("is_train = 1")
    every = [f"`{x}`" for x in lines.columns]
    prior = stage(train.agg(stats.exact_mean(c.value).alias("_prior")), "prior")
    known = train.where(F.col(c.material).isNotNull())
    days = known.groupBy(c.material, c.date).agg(F.sum(c.value).alias("_s"), F.count(c.value).alias("_n"))
    # a material has at most one row a day here
    before = Window.partitionBy(c.material).orderBy(c.date).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(c.material, c.date, F.sum("_s").over(before).cast("double").alias("_ds"), F.sum("_n").over(before).alias("_dn"))
    whole = known.groupBy(c.material).agg(F.sum(c.value).cast("double").alias("_s"), F.count(c.value).alias("_n"))
    days = days.withColumnsRenamed({"_ds": "_s", "_dn": "_n"})
    # a line is joined with the one table that its side needs
    sides = [join_checked(lines.where("is_train = 1"), days, [c.material, c.date]), join_checked(lines.where("is_train = 0"), whole, c.material)]
    f = with_scalars(sides[0].select(*every, "_s", "_n").unionByName(sides[1].select(*every, "_s", "_n")), prior)
    s, n = F.coalesce("_s", F.lit(0.0)), F.coalesce("_n", F.lit(0))
    return f.withColumn("TE_Train_Mat", (s + F.lit(float(alpha)) * F.col("_prior")) / (n + F.lit(float(alpha)))).drop("_s", "_n", "_prior")


def encoding_holdout(fp: FeaturePlan) -> DataFrame:
    """Test lines' errors with the material encoding as the prediction: fitted on all lines, as
    the original does, and on the train side."""
    c = fp.cols
    f = fp.with_material(fp.with_globals(train_side_encoding(fp)))
    # two figures a line, read for either side
    test = stage(f.where("is_train = 0").select("_v", "TE_Smooth_Mat", "TE_Train_Mat"), "holdout").select("_v", F.explode(F.array(
        F.struct(F.lit("all").alias("fit_on"), F.col("TE_Smooth_Mat").alias("p")),
        F.struct(F.lit("train").alias("fit_on"), F.col("TE_Train_Mat").alias("p")))).alias("_e")).select("_v", "_e.fit_on", "_e.p")
    parts = [regression_metrics(test.where(F.col("fit_on") == side), "_v", "p").select(F.lit(side).alias("fit_on"), "n", "r2", "rmse", "mae") for side in ("all", "train")]
    return parts[0].unionByName(parts[1])
