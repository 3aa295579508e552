"""Daily series: totals, calendar-day lag, rolling and exponentially weighted
means of earlier days (A7, A8, J9, W3-W6, W13).

The day table has one row per (series keys, day). Observed days get a dense
index through prefix counts, and every BLOCK of consecutive indexes is one
window partition, so a single long series spreads over all tasks. A rolling
mean sees the last days of the block before (sent along as a halo); an
exponentially weighted mean is the block's own decayed sums plus what the
blocks before have left, a scan over block totals in log8(blocks) steps.
No term is left out, however old.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.operators.ordered import prefix_before
from tillcast.operators.stage import stage

# Rolling windows (observed days) and EWM spans of the reference (fixed values).
ROLL_WINDOWS = (2, 3, 5, 7)
EWM_SPANS = (3, 5)


# Days of one window partition: weights within it stay far from overflow.
BLOCK = 128


def daily_totals(df: DataFrame, date: str, value: str, qty: str,
                 keys: list[str] | tuple = ()) -> DataFrame:
    """Per (keys, day): total (exact), qty sum (0 when none), line count."""
    keys = list(keys)
    return (df.groupBy(*keys, date).agg(
        F.sum(value).cast("double").alias("day_total"),
        F.coalesce(F.sum(qty), F.lit(0.0)).alias("day_qty"),
        F.count(value).alias("day_count")))


def with_day_index(daily: DataFrame, date: str, keys: list[str] | tuple = ()) -> DataFrame:
    """0-based index of each observed day within its series."""
    return prefix_before(daily, [date], None, keys, "day_idx")


def prev_calendar_day(daily: DataFrame, date: str, keys: list[str] | tuple = (),
                      cols=("day_total", "day_qty", "day_count"),
                      names=("PrevDayTotalSale", "PrevDayTotalQty", "PrevDayRowCount")) -> DataFrame:
    """Values of the calendar day exactly one day earlier; absent day -> 0."""
    keys = list(keys)
    prev = daily.select(*keys, (F.col(date) + F.expr("INTERVAL 1 DAY")).alias(date),
                        *[F.col(c).alias(f"_p_{c}") for c in cols])
    j = daily.join(prev, keys + [date], "left")
    return j.select(*daily.columns, *[F.coalesce(F.col(f"_p_{c}").cast("double"), F.lit(0.0)).alias(n)
                                      for c, n in zip(cols, names)])


def _carried(totals: DataFrame, keys: list[str], betas: dict[int, float], base: int = 8) -> DataFrame:
    """Per block the decayed sums of all days up to its end. ``totals`` has each
    block's own sums ``e{span}`` and weights ``w{span}``; in a step of s blocks each
    adds what the blocks s, 2s .. (base - 1) s before it have gathered so far, decayed, in
    this order, so that equal runs give equal sums."""
    last = totals.agg(F.max("_b")).first()[0] or 0
    cols = [f"{c}{s}" for s in betas for c in "ew"]
    step = 1
    while step <= last:
        decay = {f"{c}{s}": F.pow(F.lit(beta ** (BLOCK * step)), F.col("_j")) for s, beta in betas.items() for c in "ew"}
        sent = totals.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(base - 1)))).select(
            *keys, (F.col("_b") + F.col("_j") * step).alias("_b"), F.struct("_j", *[(F.col(c) * decay[c]).alias(c) for c in cols]).alias("_s"))
        got = sent.where(F.col("_b") <= last).groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("_s")).alias("_s"))  # ``base`` at most
        # a block that its series does not have got sums of others only
        totals = stage(got.where(F.col("_s")[0]["_j"] == 0).select(
            *keys, "_b", *[F.aggregate(F.col(f"_s.{c}"), F.lit(0.0), lambda t, x: t + x).alias(c) for c in cols]), "ewm-carry")
        step *= base
    return totals


def earlier_day_means(daily_idx: DataFrame, x: str = "day_total", keys: list[str] | tuple = (),
                      windows=ROLL_WINDOWS, spans=EWM_SPANS, roll_prefix: str = "DailyRoll",
                      ewm_prefix: str = "DailyEWM") -> DataFrame:
    """Rolling means over the previous n observed days (min 1 day) and adjusted
    EWMs of all earlier observed days; the first day gets 0 (W4, W5). A day
    without a value keeps its place but counts in no mean."""
    keys = list(keys)
    betas = {s: 1.0 - 2.0 / (s + 1.0) for s in spans}
    rows = daily_idx.withColumns({"_b": F.floor(F.col("day_idx") / BLOCK), "_p": F.col("day_idx") % BLOCK, "_halo": F.lit(False)})
    halo = (rows.where(F.col("_p") >= BLOCK - max([*windows, 0]))
            .withColumns({"_b": F.col("_b") + 1, "_p": F.col("_p") - BLOCK, "_halo": F.lit(True)}))
    order = Window.partitionBy(*keys, "_b").orderBy("day_idx")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(x).cast("double")
    own = F.when(~F.col("_halo") & value.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    cols = {f"{roll_prefix}{n}": F.avg(value).over(order.rowsBetween(-n, -1)) for n in windows}
    for s, beta in betas.items():
        # day p counts beta ** (t - 1 - p) on day t
        grow, shrink = F.pow(F.lit(1.0 / beta), F.col("_p")), F.pow(F.lit(beta), F.col("_p") - 1)
        cols[f"_e{s}"] = F.coalesce(F.sum(F.when(own > 0, value * grow)).over(earlier), F.lit(0.0)) * shrink
        cols[f"_w{s}"] = F.coalesce(F.sum(own * grow).over(earlier), F.lit(0.0)) * shrink
    out = rows.unionByName(halo).withColumns(cols).where(~F.col("_halo"))
    if betas:
        totals = rows.groupBy(*keys, "_b").agg(*[a for s, beta in betas.items() for a in (
            F.coalesce(F.sum(value * F.pow(F.lit(beta), BLOCK - 1 - F.col("_p"))), F.lit(0.0)).alias(f"e{s}"),
            F.coalesce(F.sum(F.when(value.isNotNull(), F.pow(F.lit(beta), BLOCK - 1 - F.col("_p")))), F.lit(0.0)).alias(f"w{s}"))])
        before = _carried(totals, keys, betas).withColumn("_b", F.col("_b") + 1)
        out = out.join(before, [*keys, "_b"], "left")
        for s, beta in betas.items():
            old = F.pow(F.lit(beta), F.col("_p"))
            e, w = (F.col(f"_{c}{s}") + F.coalesce(F.col(f"{c}{s}") * old, F.lit(0.0)) for c in "ew")
            out = out.withColumn(f"{ewm_prefix}{s}", F.when(w > 0, e / w))
    names = [f"{roll_prefix}{n}" for n in windows] + [f"{ewm_prefix}{s}" for s in spans]
    return out.select(*daily_idx.columns, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])


def dow_average_total(daily: DataFrame, date: str, total: str = "day_total",
                      keys: list[str] | tuple = ()) -> DataFrame:
    """Two-level aggregate: mean over days of the day total, per day of week."""
    keys = list(keys)
    return (daily.groupBy(*keys, F.weekday(date).alias("DayOfWeek"))
            .agg(F.avg(total).alias("DOW_AvgDailyTotal")))


def advanced_to(daily: DataFrame, date: str, next_date: str | None = None) -> DataFrame:
    """One row: the series' state on the forecast day (P23 with refreshed lags,
    SURVEY Q6), as if that day were the next of the series: the calendar day before it, and
    rolling and exponentially weighted means of all observed days before. Without
    ``next_date`` the day after the last. Days from the forecast day on don't count."""
    day = daily.schema[date].dataType
    if next_date:
        past = daily.where(F.col(date) < F.lit(next_date).cast(day))
        ahead = daily.sparkSession.range(1).select(F.lit(next_date).cast(day).alias(date))
    else:
        past = daily
        ahead = daily.agg((F.max(date) + F.expr("INTERVAL 1 DAY")).cast(day).alias(date))
    ahead = ahead.select(date, F.lit(True).alias("_ahead"))
    whole = past.withColumn("_ahead", F.lit(False)).unionByName(ahead, allowMissingColumns=True)
    d = earlier_day_means(prev_calendar_day(with_day_index(whole, date), date))
    return d.where("_ahead").select(
        F.col(date).alias("forecast_day"), "PrevDayTotalSale", "PrevDayTotalQty", "PrevDayRowCount",
        *[f"DailyRoll{n}" for n in ROLL_WINDOWS], *[f"DailyEWM{s}" for s in EWM_SPANS])
