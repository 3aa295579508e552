"""Random-forest forecast on the feature matrix (M2-M13), with Spark ML.

* holdout fit on the time-ordered 80 % (R5), metrics on both sides (M5),
* out-of-bag R2 as a Spark job over bags (M9),
* refit on all rows (M8) and next-day scoring of every material in one
  ``transform`` over the last-line frame (M6), no per-product loop,
* feature importances (M10), daily predicted totals (A13), history series
  (U2) and the KPI row (M13).

The reference grows 30,000 unbounded trees. MLlib bins continuous features and
stops at depth 30; the defaults here are 100 trees of that depth. A caller that
wants a smaller forest says so, and the summary row shows what was fitted.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.numeric import finite_or_zero, r4
from tillcast.operators.joins import with_scalars
from tillcast.operators.split import split_bounds, time_split
from tillcast.operators.stage import stage
from tillcast.plans import reports
from tillcast.plans.features import FeaturePlan, feature_column
from tillcast.session import ensure_checkpoint_dir
from tillcast.sources import sinks

# Forest settings of the reference that MLlib can express (fixed values).
FEATURE_FRACTION = "0.55"
SEED = 42


@dataclass
class ForestConfig:
    num_trees: int = 100
    max_depth: int = 30
    max_bins: int = 32
    min_instances: int = 1
    seed: int = SEED
    # memory of the split statistics in each task: how many nodes are grown side
    # by side, and so the order of the random feature draws, depends on it; runs
    # that are to be equal take one value, which the summary row shows
    max_memory_mb: int = 256
    # trees deeper than this keep, for each line, the node it has reached, instead
    # of walking every tree from its root at each level; the node ids are
    # checkpointed to the shared folder every so many levels
    node_cache_depth: int = 10
    checkpoint_interval: int = 10
    # one-tree fits that run side by side in the out-of-bag estimate, and how many lines
    # they may hold together (each keeps a binned copy of its lines): many lines keep a
    # cluster busy with one fit at a time
    concurrent_fits: int = 4
    lines_side_by_side: int = 2_000_000


def assembled(fp: FeaturePlan, df: DataFrame | None = None) -> DataFrame:
    """P22 + M2: sanitised feature columns -> one vector column ``features``."""
    f = fp.features if df is None else df
    cols = [finite_or_zero(feature_column(n, fp.cols)) for n in fp.feature_names]
    keep = [c for c in dict.fromkeys(("material_no", "invoice_date", "_v", "is_train", *fp.cols.order)) if c in f.columns]
    # one array of doubles: no row object with a boxed value a feature on the way
    return f.select(*keep, array_to_vector(F.array(*cols)).alias("features"))


def forest(cfg: ForestConfig, weight_col: str | None = None, bootstrap: bool = True) -> RandomForestRegressor:
    rf = RandomForestRegressor(featuresCol="features", labelCol="_v", predictionCol="prediction",
                               numTrees=cfg.num_trees, maxDepth=cfg.max_depth, maxBins=cfg.max_bins,
                               minInstancesPerNode=cfg.min_instances,
                               featureSubsetStrategy=FEATURE_FRACTION, seed=cfg.seed,
                               bootstrap=bootstrap, maxMemoryInMB=cfg.max_memory_mb,
                               cacheNodeIds=cfg.max_depth > cfg.node_cache_depth, checkpointInterval=cfg.checkpoint_interval)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def regression_metrics(df: DataFrame, label: str, pred: str, by: str | None = None) -> DataFrame:
    """R2, RMSE, MAE (A23) as aggregates; per ``by`` value when given."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    keys = [by] if by else []
    g = df.groupBy(*keys) if keys else df
    # the total sum of squares from deviations (Spark merges them as such), not from
    # sum(y^2) - n * mean^2, which cancels where the mean is large
    stats = g.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("_sse"),
                  F.sum(F.abs(y - p)).alias("_sae"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    sst = F.nullif(F.col("_sst"), F.lit(0.0))
    return stats.select(
        *[F.col(k).cast("long").alias(k) for k in keys], F.col("n").cast("long").alias("n"),
        r4(1 - F.col("_sse") / sst).alias("r2"),
        r4(F.sqrt(F.col("_sse") / F.col("n"))).alias("rmse"),
        r4(F.col("_sae") / F.col("n")).alias("mae"))


def poisson1(u):
    """Poisson(1) draw from a uniform column by inverse CDF (weights of a bag),
    as far as a double tells the steps apart."""
    cdf, term, steps = 0.0, math.exp(-1.0), []
    while cdf + term > cdf:
        cdf += term
        steps.append(cdf)
        term /= len(steps)
    out = F.lit(len(steps))
    for k, c in reversed(list(enumerate(steps))):
        out = F.when(u < F.lit(c), F.lit(k)).otherwise(out)
    return out


def bag_unit(line, bag):
    """Uniform number of a line in a bag."""
    return F.pmod(F.xxhash64(line, bag), F.lit(1 << 53)) / F.lit(float(1 << 53))


def left_out(line, spare, bag):
    """Whether a bag leaves a line out: weight 0, or it is the line's spare bag."""
    return (bag_unit(line, bag) < F.lit(math.exp(-1.0))) | F.coalesce(spare == bag, F.lit(False))


def spare_bag(line, bags: int):
    """The bag that leaves out a line which all bags would take; else null."""
    taken = F.forall(F.sequence(F.lit(0), F.lit(bags - 1)), lambda b: bag_unit(line, b) >= F.lit(math.exp(-1.0)))
    return F.when(taken, F.pmod(line, F.lit(bags)).cast("int"))


def bag_weight(line, spare, bag: int):
    return F.when(left_out(line, spare, F.lit(bag)), F.lit(0.0)).otherwise(poisson1(bag_unit(line, F.lit(bag))).cast("double"))


class Forecast:
    """Fits and scores on one feature plan; results are DataFrames."""

    def __init__(self, fp: FeaturePlan, cfg: ForestConfig | None = None, next_date: str = "2025-03-22"):
        self.fp = fp
        self.cfg = cfg or ForestConfig()
        self.next_date = next_date
        self._holdout = None
        self._full = None

    @property
    def matrix(self) -> DataFrame:
        if not hasattr(self, "_matrix"):
            ensure_checkpoint_dir(self.fp.base.sparkSession)  # of cached node ids
            # split as narrow lines; the vectors are put together as they are read
            c = self.fp.cols
            f = time_split(self.fp.fact, c.date, c.order, address="_row" if "_row" in self.fp.fact.columns else None)
            # kept as far as memory goes, and computed again beyond it: each fit reads
            # the vectors several times, and they are never written to disk
            self._matrix = assembled(self.fp, self.fp.features_of(f)).persist(StorageLevel.MEMORY_ONLY)
        return self._matrix

    def holdout_model(self):
        if self._holdout is None:
            self._holdout = forest(self.cfg).fit(self.matrix.where(F.col("is_train") == 1))
        return self._holdout

    def full_model(self):
        if self._full is None:
            self._full = forest(self.cfg).fit(self.matrix)
        return self._full

    def scored(self) -> DataFrame:
        """Every line with the holdout model's prediction (train and test, U1), scored once."""
        if not hasattr(self, "_scored"):
            out = self.holdout_model().transform(self.matrix)
            self._scored = stage(out.select("material_no", "invoice_date", "_v", "is_train", "prediction"), "scored")
        return self._scored

    def metrics(self) -> DataFrame:
        """train R2, test R2, test RMSE, test MAE (M5) as one row, and the forest that was fitted."""
        model = self.holdout_model()
        return summary(self.scored()).select("train_r2", "test_r2", "rmse", "mae").withColumns({
            "num_trees": F.lit(model.getNumTrees), "max_depth": F.lit(self.cfg.max_depth), "max_memory_mb": F.lit(self.cfg.max_memory_mb),
            "n_nodes": F.lit(int(model.totalNumNodes))})

    def oob_predictions(self, bags: int | None = None) -> DataFrame:
        """Every train line with its out-of-bag prediction. Each bag draws
        Poisson(1) row weights and fits one tree on the weighted rows; a line that no
        bag would leave out is left out of the one its hash names. The
        prediction is the mean over the bags that left the line out, taken on the line
        itself: no line is lost or merged. There are as many bags as the
        forest has trees, if not told otherwise.

        All weights of a line are one long, its hash: weight b is drawn from the hash
        of that long and b where it is needed. The fits read the vectors that ``matrix``
        keeps and run ``concurrent_fits`` at a time (fewer where there are many lines);
        scoring is one pass that puts the trees' predictions into one array."""
        bags = self.cfg.num_trees if bags is None else bags
        line = F.xxhash64(*[F.col(c) for c in self.fp.cols.order])
        f = self.matrix.where(F.col("is_train") == 1).select(*self.fp.cols.order, "_v", "features", line.alias("_line"))
        f = f.withColumn("_spare", spare_bag(F.col("_line"), bags))
        one = replace(self.cfg, num_trees=1)
        trees = [forest(one, weight_col=f"_w{b}", bootstrap=False) for b in range(bags)]

        @inheritable_thread_target(f.sparkSession)
        def fit(b: int):
            weight = bag_weight(F.col("_line"), F.col("_spare"), b).alias(f"_w{b}")
            return trees[b].fit(f.select("features", "_v", weight).where(F.col(f"_w{b}") > 0))
        n = f.count()  # the vectors are kept before the fits ask for them side by side
        with ThreadPoolExecutor(max(1, min(self.cfg.concurrent_fits, bags, self.cfg.lines_side_by_side // max(n, 1)))) as pool:
            models = list(pool.map(fit, range(bags)))
        out = f
        for b, model in enumerate(models):
            out = model.setPredictionCol(f"_p{b}").transform(out)
        # (bag, prediction) of the bags that left the line out
        bag = F.transform(F.array(*[F.col(f"_p{b}") for b in range(bags)]),
                          lambda p, b: F.when(left_out(F.col("_line"), F.col("_spare"), b), p))
        own = F.filter(bag, lambda p: p.isNotNull())
        mean = F.aggregate(own, F.lit(0.0), lambda t, p: t + p) / F.size(own)
        return stage(out.select(*self.fp.cols.order, "_v", mean.alias("prediction")), "oob")

    def oob_r2(self, bags: int | None = None) -> DataFrame:
        """M9: out-of-bag R2 over all train lines."""
        return regression_metrics(self.oob_predictions(bags), "_v", "prediction").select(
            F.col("r2").alias("oob_r2"), F.col("n").alias("n_oob_rows"))

    def importance(self, k: int = 20) -> DataFrame:
        """The k most important features of the holdout model."""
        imp = self.holdout_model().featureImportances.toArray().tolist()
        spark = self.fp.base.sparkSession
        rows = [(self.fp.feature_names[i], float(v)) for i, v in enumerate(imp)]
        df = spark.createDataFrame(rows, "feature string, importance double")
        return df.orderBy(F.desc("importance"), "feature").limit(k)

    def next_day_products(self) -> DataFrame:
        """M6: one forecast per material for the next day, 18 report fields."""
        fp = self.fp
        ctx = reports.next_day_context(fp.base.sparkSession, self.next_date, fp.weather_row)
        rows = reports.next_day_rows(fp.last_features, ctx, fp.cols.qty, fp.cols.soh)
        scored = self.full_model().transform(assembled(fp, rows)).select(
            fp.cols.material, F.col("prediction").alias("score"))
        # the report's other fields need no more than the material's statistics
        return reports.product_frame(fp.with_material(fp.with_globals(fp.last_lines)), fp.meta, scored, ctx, fp.cols.material, fp.cols.value,
                                     fp.cols.qty, fp.cols.soh, fp.cols.indent)

    def last_row_forecast(self) -> DataFrame:
        """M7: forecast for the last line of the whole table with the same
        forecast-day overrides (the script variant; a single number)."""
        fp = self.fp
        ctx = reports.next_day_context(fp.base.sparkSession, self.next_date, fp.weather_row)
        rows = reports.next_day_rows(fp.last_line_features, ctx, fp.cols.qty, fp.cols.soh)
        return self.full_model().transform(assembled(fp, rows)).select(
            fp.cols.material, F.col("prediction").alias("last_row_forecast"))

    def test_pairs(self) -> DataFrame:
        """Actual and predicted values of the test lines, with the chart
        bounds (min * 0.85, max * 1.08) on every row."""
        s = self.scored().where(F.col("is_train") == 0).select(
            F.col("_v").alias("actual"), F.col("prediction").alias("predicted"))
        lo_hi = s.agg(F.least(F.min("actual"), F.min("predicted")).alias("_lo"),
                      F.greatest(F.max("actual"), F.max("predicted")).alias("_hi"))
        return with_scalars(s, lo_hi.select((F.col("_lo") * 0.85).alias("axis_min"),
                                            (F.col("_hi") * 1.08).alias("axis_max")))

    def daily_predicted(self) -> DataFrame:
        """Predicted total per day from the holdout model."""
        return (self.scored().groupBy("invoice_date")
                .agg(F.sum("prediction").alias("Predicted")).orderBy("invoice_date"))

    def history_series(self) -> DataFrame:
        """See :func:`history_series`."""
        total = self.next_day_products().agg(F.sum("predicted_sale").alias("value"))
        return history_series(self.fp.daily, self.scored(), total, self.next_date)

    def kpi_row(self, bags: int | None = None) -> DataFrame:
        """Total forecast, metrics, OOB R2, counts of rows and
        features, and the size of the forest that was fitted."""
        total = self.next_day_products().agg(F.sum("predicted_sale").alias("total_forecast"))
        row = with_scalars(with_scalars(total, summary(self.scored())), self.oob_r2(bags))
        return row.withColumns({"n_features": F.lit(len(self.fp.feature_names)), "num_trees": F.lit(self.cfg.num_trees), "max_depth": F.lit(self.cfg.max_depth), "max_memory_mb": F.lit(self.cfg.max_memory_mb)})

    def write_bundle(self, root: str) -> dict[str, str]:
        """Everything a run returns, a Parquet table each: products, metrics,
        daily actual and predicted totals, split dates and forecast-day context."""
        fp = self.fp
        return sinks.write_bundle(root, {
            "products": self.next_day_products(), "metrics": self.kpi_row(),
            "daily_actual": fp.daily.select("invoice_date", "day_total"), "daily_predicted": self.daily_predicted(),
            "split_dates": split_bounds(self.scored(), "invoice_date"),
            "context": reports.next_day_context(fp.base.sparkSession, self.next_date, fp.weather_row)})


def summary(scored: DataFrame) -> DataFrame:
    """One row: train R2, test R2, RMSE and MAE, and the row counts, in one pass
    over lines with ``_v``, ``prediction`` and ``is_train``."""
    m = regression_metrics(scored, "_v", "prediction", by="is_train")
    at = lambda side, c: F.max(F.when(F.col("is_train") == side, F.col(c)))
    return m.agg(at(1, "r2").alias("train_r2"), at(0, "r2").alias("test_r2"), at(0, "rmse").alias("rmse"), at(0, "mae").alias("mae"),
                 F.sum("n").alias("n_rows"), F.coalesce(at(1, "n"), F.lit(0)).alias("n_train"), F.coalesce(at(0, "n"), F.lit(0)).alias("n_test"))


def history_series(daily: DataFrame, scored: DataFrame, total: DataFrame, next_date: str) -> DataFrame:
    """Actual daily totals, predicted daily totals up to the last train day and
    from the first test day on (a day cut by the split is in both, with its full
    total), and the forecast point, as (series, invoice_date, value)."""
    # one pass over the lines: a row a day, with the sides of the split that its lines are on
    days = stage(scored.groupBy("invoice_date").agg(F.sum("prediction").alias("value"), F.max("is_train").alias("_some_train"), F.min("is_train").alias("_all_train")), "predicted-days")
    bounds = days.agg(F.max(F.when(F.col("_some_train") == 1, F.col("invoice_date"))).alias("last_train_date"),
                      F.min(F.when(F.col("_all_train") == 0, F.col("invoice_date"))).alias("first_test_date"))
    pred = with_scalars(days.select("invoice_date", "value"), bounds)
    out = daily.select(F.lit("actual").alias("series"), "invoice_date", F.col("day_total").alias("value"))
    for name, keep in (("train_predicted", F.col("invoice_date") <= F.col("last_train_date")), ("test_predicted", F.col("invoice_date") >= F.col("first_test_date"))):
        out = out.unionAll(pred.where(keep).select(F.lit(name), "invoice_date", "value"))
    return out.unionAll(total.select(F.lit("forecast"), F.to_timestamp_ntz(F.lit(next_date)), "value"))
