"""Named queries over the star-schema test tables.

Each function takes (spark, sf_dir) and returns a DataFrame; every one reads
the whole tables through the sheet adapter. Doubles are reported with
:func:`r4` so that results compare across engines; money is summed exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions import calendar as cal
from tillcast.functions.numeric import money, r4
from tillcast.operators import series
from tillcast.operators.asof import asof_join
from tillcast.operators.clean import clean_indent
from tillcast.operators.enrich import master_multiplicity, product_meta
from tillcast.operators.joins import with_scalars
from tillcast.operators.skew import split_join
from tillcast.operators.split import split_bounds as _split_bounds
from tillcast.operators.split import time_split as _time_split
from tillcast.operators.stats import group_stats
from tillcast.plans import reports
from tillcast.plans.features import FEATURES, FeaturePlan, feature_column
from tillcast.sources.sheets import load_table, tpch_all_masters, tpch_sheets, tpch_weather_history
from tillcast.sources.weather import DEFAULT_HUMIDITY, DEFAULT_TEMP, DEFAULT_WIND, parse_weather, read_weather, weather_context

NEXT_DATE = "2025-03-22"   # forecast day of the reference's default run
FILTER_CATEGORY = "STANDARD"
SEARCH_TEXT = "red|steel"  # a regular expression, like the reference's search box

_PLANS: dict = {}


def folder_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names and times of change of what lies in a folder: a plan is not kept
    when its tables change."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files))


def plan(spark: SparkSession, sf_dir: str) -> FeaturePlan:
    """Feature plan for a folder of tables (one per session and folder, so that
    the staged fact is written once and shared by the queries)."""
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir))
    if key not in _PLANS:
        sheets = tpch_sheets(spark, sf_dir)
        w = weather_context(parse_weather(read_weather(spark)))
        _PLANS[key] = FeaturePlan(sheets, w)
    return _PLANS[key]


def _ids(extra_double=(), extra_long=(), extra_other=()):
    cols = [F.col("l_orderkey").cast("long").alias("l_orderkey"),
            F.col("l_linenumber").cast("long").alias("l_linenumber"),
            F.col("material_no"), F.col("l_suppkey").cast("long").alias("l_suppkey")]
    cols += [r4(c).alias(a) for c, a in extra_double]
    cols += [F.col(c).cast("long").alias(a) for c, a in extra_long]
    cols += [F.col(c).alias(a) for c, a in extra_other]
    return cols


def _same(names):
    return [(n, n) for n in names]


def _fact_with(fp: FeaturePlan, *stages):
    f = fp.with_globals(fp.base)
    for s in stages:
        f = s(f)
    return f


# ---- cleaning and joins --------------------------------------------------
def q_clean_indent(spark, d):
    return clean_indent(tpch_sheets(spark, d).indent).select(
        "sap_code", r4("soh").alias("soh"), r4("indent").alias("indent"))


def q_enrich_left_joins(spark, d):
    fp = plan(spark, d)
    f = fp.joined.withColumn("sku_hit", F.coalesce(F.col("_sku_hit"), F.lit(0)))
    return f.select(*_ids(_same(["soh", "indent", "crt_size", "no_crts"]), [("sku_hit", "sku_hit")],
                          _same(["vendor", "type"])))


def q_fill_defaults(spark, d):
    fp = plan(spark, d)
    return fp.filled.select(*_ids(_same(["soh", "indent", "crt_size", "no_crts"]), (),
                                  _same(["vendor", "type"])))


def q_dedup_first(spark, d):
    """First master row per material out of one for every (part, supplier) pair."""
    return product_meta(tpch_all_masters(spark, d)).select("material_no", "category_label", "mat_description",
                                                           "vendor_name", "display_name")


def q_master_multiplicity(spark, d):
    fp = plan(spark, d)
    return master_multiplicity(fp.sales, tpch_all_masters(spark, d), fp.cols)


# ---- row features --------------------------------------------------------
def q_price_qty_features(spark, d):
    fp = plan(spark, d)
    return fp.base.select(*_ids([("sal_qty", "SalQty")] + _same(
        ["PricePerUnit", "QtyXPrice", "Log_SalQty", "Log_Price", "Log_QtyXPrice", "Sqrt_QtyXPrice"])))


def q_stock_features(spark, d):
    fp = plan(spark, d)
    return fp.base.select(*_ids([("soh", "SOH"), ("indent", "Indent")] + _same(
        ["StockPressure", "StockCoverage", "IndentRatio", "Stock_Demand"])))


# ---- group statistics ----------------------------------------------------
MAT_STATS = ["Mat_AvgSale", "Mat_MedSale", "Mat_MaxSale", "Mat_MinSale", "Mat_StdSale",
             "Mat_SumSale", "Mat_Count", "Mat_AvgQty", "Mat_AvgPrice", "Mat_MedPrice"]
GROUP_STATS = ("AvgSale", "MedSale", "MaxSale", "SumSale", "AvgQty", "AvgPrice", "Count")


def q_material_stats(spark, d):
    m = plan(spark, d).M_stats
    return m.select("material_no", *[_stat(c) for c in MAT_STATS])


def _stat(c):
    """A group statistic as reported: counts whole, sums of money to the cent."""
    return (F.col(c).cast("long") if c.endswith("_Count") else money(c) if c.endswith("_SumSale") else r4(c)).alias(c)


def _group_query(spark, d, key, prefix):
    fp = plan(spark, d)
    g = group_stats(fp.base, key, prefix, "sale_value", "sal_qty", "PricePerUnit", GROUP_STATS)
    return g.select(F.col(key), *[_stat(f"{prefix}_{s}") for s in GROUP_STATS])


def q_sku_stats(spark, d):
    return _group_query(spark, d, "sku", "SKU")


def q_category_stats(spark, d):
    return _group_query(spark, d, "category", "Category")


def q_vendor_stats(spark, d):
    return _group_query(spark, d, "vendor", "VENDOR")


def q_shortname_stats(spark, d):
    n = plan(spark, d).N
    return n.select("short_name", *[_stat(c) for c in ("SN_AvgSale", "SN_SumSale", "SN_AvgPrice", "SN_AvgQty")])


def q_global_stats(spark, d):
    fp = plan(spark, d)
    return with_scalars(fp.G, fp.median_soh).select(
        r4("global_mean").alias("global_mean"), r4("median_soh").alias("median_soh"),
        "min_date", F.col("max_mat_count").cast("long").alias("max_mat_count"),
        F.col("row_count").cast("long").alias("row_count"))


def q_weighted_price(spark, d):
    return plan(spark, d).C.select("category", r4("Cat_WAvgPrice").alias("Cat_WAvgPrice"))


# ---- encodings and shares ------------------------------------------------
def q_recon_ensemble(spark, d):
    fp = plan(spark, d)
    f = _fact_with(fp, fp.with_material, fp.with_groups, fp.with_recon)
    return f.select(*_ids(_same(["ReconEnsemble", "ResidFromRecon", "Log_ReconEns"])))


def q_loo_encoding(spark, d):
    fp = plan(spark, d)
    f = _fact_with(fp, fp.with_material, fp.with_groups, fp.with_daily)
    return f.select(*_ids(_same(["TE_LOO_Mat", "TE_LOO_SKU", "DateLOO_Sale", "DateLOO_Qty", "DateLOO_Mean"])))


def q_smooth_encoding(spark, d):
    fp = plan(spark, d)
    f = _fact_with(fp, fp.with_material)
    return f.select(*_ids(_same(["TE_Smooth_Mat", "QtyXTESmooth", "TE_Smooth_MatDOW", "QtyXTE_MatDOW"])))


def q_mat_zscore(spark, d):
    fp = plan(spark, d)
    return _fact_with(fp, fp.with_material).select(*_ids(_same(["Sale_MatZscore"])))


def q_mat_minmax(spark, d):
    fp = plan(spark, d)
    return _fact_with(fp, fp.with_material).select(
        *_ids(_same(["Mat_SaleRange", "Mat_SaleNorm", "Mat_FreqWeight"])))


def q_share_of_day(spark, d):
    fp = plan(spark, d)
    return _fact_with(fp, fp.with_daily).select(*_ids(_same(["SaleVsDateTotal"])))


def q_mat_dow_features(spark, d):
    fp = plan(spark, d)
    return _fact_with(fp, fp.with_material).select(*_ids(_same(["Mat_DOW_AvgSale", "QtyXMatDOWAvg"])))


def q_dow_avg_total(spark, d):
    fp = plan(spark, d)
    t = series.dow_average_total(fp.daily, "invoice_date")
    return t.select(F.col("DayOfWeek").cast("long").alias("DayOfWeek"),
                    r4("DOW_AvgDailyTotal").alias("DOW_AvgDailyTotal"))


def q_season_lift(spark, d):
    fp = plan(spark, d)
    f = _fact_with(fp, fp.with_material)
    return f.select(*_ids(_same(["Mat_SeasonAvgSale", "SeasonalLift", "SeasonalLiftXQty", "SeasonalXQty"]),
                          [("IsSeasonalProduct", "IsSeasonalProduct")]))


# ---- calendar ------------------------------------------------------------
def _days(fp: FeaturePlan):
    return fp.with_globals(fp.base).select("invoice_date", "min_date").distinct()


def q_calendar_features(spark, d):
    fp = plan(spark, d)
    dt = F.col("invoice_date")
    dsin, dcos = cal.cyclic(cal.weekday(dt), 7)
    msin, mcos = cal.cyclic(F.month(dt), 12)
    days = F.floor((F.unix_micros(dt.cast("timestamp")) - F.unix_micros(F.col("min_date").cast("timestamp")))
                   / F.lit(86400000000))
    return _days(fp).select(
        "invoice_date",
        cal.weekday(dt).cast("long").alias("DayOfWeek"), F.dayofmonth(dt).cast("long").alias("DayOfMonth"),
        cal.weekday(dt).isin(5, 6).cast("long").alias("IsWeekend"), days.cast("long").alias("DaysSinceStart"),
        r4(dsin).alias("DOW_sin"), r4(dcos).alias("DOW_cos"), F.month(dt).cast("long").alias("Month"),
        cal.season_code(F.month(dt)).cast("long").alias("SeasonCode"),
        cal.season_name(F.month(dt)).alias("SeasonName"),
        r4(msin).alias("Month_sin"), r4(mcos).alias("Month_cos"))


def q_festive_flag(spark, d):
    fp = plan(spark, d)
    dt = F.col("invoice_date")
    return _days(fp).select("invoice_date", cal.is_festive(F.month(dt), F.dayofmonth(dt)).cast("long").alias("IsFestive"))


def q_traffic_delay(spark, d):
    fp = plan(spark, d)
    dt = F.col("invoice_date")
    f = with_scalars(_days(fp), fp.weather_row, ["w_is_rainy"])
    return f.select("invoice_date",
                    r4(cal.traffic_index(cal.weekday(dt), F.col("w_is_rainy"))).alias("TrafficIndex"),
                    r4(cal.delay_index(cal.weekday(dt), F.col("w_is_rainy"))).alias("DeliveryDelayIndex"))


def q_weather_features(spark, d):
    fp = plan(spark, d)
    f = fp.with_weather(fp.base)
    return f.select(*_ids([("w_temperature", "Temperature"), ("w_humidity", "Humidity"),
                           ("w_wind_speed", "WindSpeed"), ("w_rain_1h", "Rain_1h"),
                           ("w_heat_index", "HeatIndex")] +
                          _same(["TempXQty", "TempXPrice", "HumidXQty", "RainXQty",
                                 "TrafficXQty", "TrafficXPrice"]),
                          [("w_is_rainy", "IsRainy")]))


# ---- daily series --------------------------------------------------------
def q_daily_totals(spark, d):
    fp = plan(spark, d)
    return fp.daily.select("invoice_date", money("day_total").alias("day_total"), r4("day_qty").alias("day_qty"),
                           F.col("day_count").cast("long").alias("day_count"))


def _dcols(fp, names):
    return fp.D.select("invoice_date", *[r4(n).alias(n) for n in names])


def q_prev_day(spark, d):
    return _dcols(plan(spark, d), ["PrevDayTotalSale", "PrevDayTotalQty", "PrevDayRowCount"])


def q_rolling_means(spark, d):
    return _dcols(plan(spark, d), ["DailyRoll2", "DailyRoll3", "DailyRoll5", "DailyRoll7"])


def q_ewm_means(spark, d):
    return _dcols(plan(spark, d), ["DailyEWM3", "DailyEWM5"])


def q_momentum_trend(spark, d):
    return _dcols(plan(spark, d), ["DailyMomentum", "DailyTrend3v7"])


def _events_daily(spark, d):
    ev = load_table(spark, d, "events")
    daily = (ev.groupBy("event_type", F.to_date("ts").cast("timestamp_ntz").alias("day"))
             .agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("day_total")))
    return series.with_day_index(daily, "day", ["event_type"])


def q_events_rolling(spark, d):
    e = series.earlier_day_means(_events_daily(spark, d), keys=["event_type"], spans=())
    return e.select("event_type", "day", *[r4(f"DailyRoll{n}").alias(f"roll{n}") for n in series.ROLL_WINDOWS])


def q_events_ewm(spark, d):
    e = series.earlier_day_means(_events_daily(spark, d), keys=["event_type"], windows=(1,))
    return e.select("event_type", "day", *[r4(f"DailyEWM{s}").alias(f"ewm{s}") for s in series.EWM_SPANS])


# ---- ranks, codes, split -------------------------------------------------
def q_pct_ranks(spark, d):
    fp = plan(spark, d)
    f = fp.with_ranks(fp.base).join(fp.M.select("material_no", "MatAvg_rank"), "material_no", "left")
    return f.select(*_ids(_same(["SalQty_rank", "Price_rank", "MatAvg_rank", "QtyXPrice_rank"])))


def q_label_codes(spark, d):
    fp = plan(spark, d)
    f = fp.with_codes(fp.base)
    return f.select(*_ids((), _same(["Category_code", "SKU_code", "VENDOR_code", "TYPE_code",
                                     "ShortName_code", "MaterialName_code"])))


def _split(fp):
    return _time_split(fp.base, "invoice_date", fp.cols.order)


def q_time_split(spark, d):
    return _split(plan(spark, d)).select(*_ids((), [("is_train", "is_train")]))


def q_split_bounds(spark, d):
    return _split_bounds(_split(plan(spark, d)), "invoice_date")


# ---- feature matrix ------------------------------------------------------
FEATURE_CHUNK = 16   # features per aggregate: keeps each aggregate inside generated code


def q_feature_matrix(spark, d):
    """Per feature: rows, values that were NULL/NaN/inf before sanitising (Q11),
    zeros, min and max of the sanitised matrix column.

    Features are aggregated in chunks (each chunk reads only its columns of
    the staged table, one row out), and each chunk's row is stacked into one
    row per feature."""
    from tillcast.functions.numeric import finite_or_zero
    fp = plan(spark, d)
    f = fp.features
    parts = []
    for start in range(0, len(FEATURES), FEATURE_CHUNK):
        idx = range(start, min(start + FEATURE_CHUNK, len(FEATURES)))
        aggs = []
        for i in idx:
            raw = F.col(f"`{feature_column(FEATURES[i], fp.cols)}`").cast("double")
            x = finite_or_zero(raw)
            bad = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
            aggs += [F.sum(bad.cast("long")).alias(f"b{i}"), F.sum((x == 0).cast("long")).alias(f"z{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        wide = f.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
        rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(FEATURES[i]).alias("feature"),
                                            F.col(f"b{i}").alias("n_nonfinite"), F.col(f"z{i}").alias("n_zero"),
                                            F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
                                   for i in idx]))
        parts.append(wide.select("n_rows", rows.alias("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("s.pos", "s.feature", "n_rows", "s.n_nonfinite", "s.n_zero",
                      r4("s.lo").alias("min_value"), r4("s.hi").alias("max_value"))


# ---- last rows and next day ----------------------------------------------
def _last_stats(fp):
    """Last lines with material features only, for reports that need no more."""
    return fp.with_material(fp.with_globals(fp.last_lines))


def q_last_row_per_material(spark, d):
    fp = plan(spark, d)
    last = fp.last_lines
    return last.select("material_no", F.col("l_orderkey").cast("long").alias("l_orderkey"),
                       F.col("l_linenumber").cast("long").alias("l_linenumber"),
                       F.col("l_suppkey").cast("long").alias("l_suppkey"), "invoice_date",
                       r4("_v").alias("last_actual"), r4("sal_qty").alias("SalQty"),
                       r4("PricePerUnit").alias("PricePerUnit"))


OVERRIDES = ["Temperature", "Humidity", "WindSpeed", "Rain_1h", "IsRainy", "HeatIndex", "TempXQty",
             "TempXPrice", "HumidXQty", "RainXQty", "TrafficIndex", "DeliveryDelayIndex", "TrafficXQty",
             "TrafficXPrice", "Month", "SeasonCode", "Month_sin", "Month_cos", "IsFestive", "Stock_Demand"]


def _next_rows(spark, fp):
    ctx = reports.next_day_context(spark, NEXT_DATE, fp.weather_row)
    return reports.next_day_rows(fp.last_features, ctx, "sal_qty", "soh")


def q_next_day_rows(spark, d):
    fp = plan(spark, d)
    rows = _next_rows(spark, fp)
    return rows.select("material_no", *[r4(feature_column(n, fp.cols)).alias(n) for n in OVERRIDES],
                       r4("DailyRoll3").alias("DailyRoll3"), F.col("DayOfWeek").cast("long").alias("DayOfWeek"))


def q_next_day_lags(spark, d):
    """Q6: next-day rows with the daily lags of the day after the last."""
    fp = plan(spark, d)
    state = series.advanced_to(fp.daily, fp.cols.date)
    rows = reports.refreshed_lags(_next_rows(spark, fp), state, series.dow_average_total(fp.daily, fp.cols.date), fp.G, "sal_qty")
    return rows.select("material_no", *[r4(c).alias(c) for c in REFRESHED])


REFRESHED = ["PrevDayTotalSale", "PrevDayTotalQty", "PrevDayRowCount", "DailyRoll2", "DailyRoll3", "DailyRoll5", "DailyRoll7", "DailyEWM3", "DailyEWM5",
             "DailyMomentum", "DailyTrend3v7", "PrevDayXPrice", "PrevDayXQty", "DailyRoll3XQty", "DailyRoll3XPrice", "DailyEWM3XQty", "DOW_AvgDailyTotal", "SaleVsDOWTotal"]


def q_train_side_encoding(spark, d):
    """Q4: encodings of the train side, earlier days only on it."""
    from tillcast.plans.train_side import train_side_encoding
    return train_side_encoding(plan(spark, d)).select(*_ids(_same(["TE_Train_Mat"]), [("is_train", "is_train")]))


def q_encoding_holdout(spark, d):
    from tillcast.plans.train_side import encoding_holdout
    return encoding_holdout(plan(spark, d))


def q_weather_by_date(spark, d):
    """Q5: each line with the latest landed reading before its day."""
    fp = plan(spark, d)
    f = asof_join(fp.base.drop("is_rainy"), tpch_weather_history(spark, d), fp.cols.date, "reading_time", "event_id", ["temperature", "humidity", "wind_speed", "is_rainy"])
    f = f.withColumns({"temperature": F.coalesce("temperature", F.lit(DEFAULT_TEMP)), "humidity": F.coalesce("humidity", F.lit(DEFAULT_HUMIDITY)),
                       "wind_speed": F.coalesce("wind_speed", F.lit(DEFAULT_WIND)), "is_rainy": F.coalesce("is_rainy", F.lit(0))})
    return f.select(*_ids([*_same(["temperature", "humidity", "wind_speed"]), (F.col("temperature") * F.col("sal_qty"), "TempXQty"),
                           (cal.traffic_index("DayOfWeek", "is_rainy"), "TrafficIndex")], [("is_rainy", "is_rainy")]))


def q_split_masters(spark, d):
    """J1 with several master rows a material, and one material that a third of the lines are booked on."""
    fp = plan(spark, d)
    lines = fp.sales.select(F.when(F.col("l_orderkey") % 3 == 0, F.lit("1")).otherwise(F.col("material_no")).alias("material_no"), "l_orderkey", "l_linenumber", "sale_value")
    masters = tpch_all_masters(spark, d).select(F.col("sap_code").alias("material_no"), "vendor", "type")
    return (split_join(lines, masters, "material_no").groupBy("material_no", "vendor", "type")
            .agg(F.count(F.lit(1)).alias("n_lines"), money(F.sum("sale_value")).alias("total_sale")))


# ---- profile and reports on a deterministic score ------------------------
def q_profile(spark, d):
    fp = plan(spark, d)
    f = _fact_with(fp, fp.with_material)
    return f.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("invoice_date").alias("n_days"),
        F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"),
        F.sum("IsFestive").cast("long").alias("n_festive_rows"),
        F.sum("IsWeekend").cast("long").alias("n_weekend_rows"),
        F.sum("IsSeasonalProduct").cast("long").alias("n_seasonal_rows"),
        r4(F.min("_v")).alias("target_min"), r4(F.max("_v")).alias("target_max"),
        r4(F.sum("sale_value").cast("double") / F.count("sale_value")).alias("target_mean"))


def q_season_counts(spark, d):
    fp = plan(spark, d)
    return (fp.base.groupBy(cal.season_name(F.col("Month")).alias("SeasonName"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "SeasonName"))


def score_products(spark, d, score: DataFrame | None = None) -> DataFrame:
    """Product frame; the default score is the smoothed material mean
    (TE_Smooth_Mat) in place of a model prediction."""
    fp = plan(spark, d)
    if score is None:
        from tillcast.operators.stats import smooth_encode
        from tillcast.plans.features import ALPHA_MAT
        score = with_scalars(fp.M_stats, fp.G, ["global_mean"]).select(
            "material_no", smooth_encode(F.col("Mat_Count"), F.col("Mat_AvgSale"),
                                         F.col("global_mean"), ALPHA_MAT).alias("score"))
    ctx = reports.next_day_context(spark, NEXT_DATE, fp.weather_row)
    return reports.product_frame(_last_stats(fp), fp.meta, score, ctx, "material_no", "sale_value",
                                 "sal_qty", "soh", "indent")


def q_category_list(spark, d):
    return reports.category_list(score_products(spark, d))


def q_search_products(spark, d):
    return reports.search_products(score_products(spark, d), SEARCH_TEXT)


def q_top_products(spark, d):
    return reports.top_products(score_products(spark, d))


def q_category_summary(spark, d):
    s = reports.category_summary(score_products(spark, d))
    return s.select("category", r4("total_predicted").alias("total_predicted"), "n_products",
                    r4("mean_lift").alias("mean_lift"))


def _top_material(products):
    return products.orderBy(F.desc_nulls_last("predicted_sale"), "material_no").limit(1)


def q_product_history(spark, d):
    fp = plan(spark, d)
    top = _top_material(score_products(spark, d))
    out = reports.product_history(fp.base, top, "material_no", "invoice_date", "sale_value", NEXT_DATE)
    return out.select("series", "invoice_date", money("value").alias("value"))


def q_product_row(spark, d):
    p = score_products(spark, d)
    return reports.product_row(p, _top_material(p).select("display_name").scalar())


def q_filtered_products(spark, d):
    """Category and season filters, sorted by stock."""
    p = score_products(spark, d)
    return reports.search_products(p, None, FILTER_CATEGORY, "In-Season Only", "soh")


def q_shown_counts(spark, d):
    return reports.shown_counts(score_products(spark, d), text=SEARCH_TEXT, in_season="Off-Season Only")


def q_format_report(spark, d):
    return reports.format_report(score_products(spark, d))


def q_day_labels(spark, d):
    """Marks and date forms of the forecast day, beside the table's first date."""
    fp = plan(spark, d)
    labels = reports.day_labels(reports.next_day_context(spark, NEXT_DATE, fp.weather_row))
    return with_scalars(labels, fp.G, ["min_date"]).withColumn("first_day", F.date_format("min_date", "dd MMM")).drop("min_date")


def _pairs(fp):
    """Lines with a stand-in prediction (the material mean) and their side of the split."""
    f = fp.with_material(fp.with_globals(_split(fp)))   # split first: the statistics are joined once
    return f.withColumn("prediction", F.col("Mat_AvgSale"))


def q_metrics_from_pairs(spark, d):
    """A23 on a stand-in prediction (the material mean) per split side."""
    from tillcast.plans.forecast import regression_metrics
    return regression_metrics(_pairs(plan(spark, d)), "_v", "prediction", by="is_train")


def q_history_from_pairs(spark, d):
    """P17, U1, U2, A13, Y4 on the stand-in prediction."""
    from tillcast.plans.forecast import history_series
    fp = plan(spark, d)
    total = score_products(spark, d).agg(F.sum("predicted_sale").alias("value"))
    out = history_series(fp.daily, _pairs(fp), total, NEXT_DATE)
    return out.select("series", "invoice_date", r4("value").alias("value"))


def q_kpi_from_pairs(spark, d):
    """A16, M13, Y1 on the stand-in prediction: the summary's texts and row counts."""
    from tillcast.plans.forecast import summary
    total = score_products(spark, d).agg(F.sum("predicted_sale").alias("total_forecast"))
    return reports.kpi_texts(with_scalars(total, summary(_pairs(plan(spark, d)))))


CATALOG = {
    "clean_indent": q_clean_indent,
    "enrich_left_joins": q_enrich_left_joins,
    "fill_defaults": q_fill_defaults,
    "dedup_first": q_dedup_first,
    "master_multiplicity": q_master_multiplicity,
    "price_qty_features": q_price_qty_features,
    "stock_features": q_stock_features,
    "material_stats": q_material_stats,
    "sku_stats": q_sku_stats,
    "category_stats": q_category_stats,
    "vendor_stats": q_vendor_stats,
    "shortname_stats": q_shortname_stats,
    "global_stats": q_global_stats,
    "weighted_price": q_weighted_price,
    "recon_ensemble": q_recon_ensemble,
    "loo_encoding": q_loo_encoding,
    "smooth_encoding": q_smooth_encoding,
    "mat_zscore": q_mat_zscore,
    "mat_minmax": q_mat_minmax,
    "share_of_day": q_share_of_day,
    "mat_dow_features": q_mat_dow_features,
    "dow_avg_total": q_dow_avg_total,
    "season_lift": q_season_lift,
    "calendar_features": q_calendar_features,
    "festive_flag": q_festive_flag,
    "traffic_delay": q_traffic_delay,
    "weather_features": q_weather_features,
    "daily_totals": q_daily_totals,
    "prev_day": q_prev_day,
    "rolling_means": q_rolling_means,
    "ewm_means": q_ewm_means,
    "momentum_trend": q_momentum_trend,
    "events_rolling": q_events_rolling,
    "events_ewm": q_events_ewm,
    "pct_ranks": q_pct_ranks,
    "label_codes": q_label_codes,
    "time_split": q_time_split,
    "split_bounds": q_split_bounds,
    "feature_matrix": q_feature_matrix,
    "last_row_per_material": q_last_row_per_material,
    "next_day_rows": q_next_day_rows,
    "next_day_lags": q_next_day_lags,
    "train_side_encoding": q_train_side_encoding,
    "encoding_holdout": q_encoding_holdout,
    "weather_by_date": q_weather_by_date,
    "split_masters": q_split_masters,
    "profile": q_profile,
    "season_counts": q_season_counts,
    "category_list": q_category_list,
    "search_products": q_search_products,
    "top_products": q_top_products,
    "category_summary": q_category_summary,
    "product_history": q_product_history,
    "product_row": q_product_row,
    "format_report": q_format_report,
    "day_labels": q_day_labels,
    "filtered_products": q_filtered_products,
    "shown_counts": q_shown_counts,
    "history_from_pairs": q_history_from_pairs,
    "kpi_from_pairs": q_kpi_from_pairs,
    "metrics_from_pairs": q_metrics_from_pairs,
}


# ---- forest (checked on rows only: no SQL form) ---------------------------
# The registered forest is smaller than the library's default (100 trees of
# depth 30) so that a query takes seconds on the test tables; its size is a
# column of rf_metrics and kpi_row.
QUERY_TREES, QUERY_DEPTH = 20, 8
_FORECASTS: dict = {}


def forecast(spark, d):
    from tillcast.plans.forecast import Forecast, ForestConfig
    fp = plan(spark, d)
    if id(fp) not in _FORECASTS:
        _FORECASTS[id(fp)] = Forecast(fp, ForestConfig(num_trees=QUERY_TREES, max_depth=QUERY_DEPTH), next_date=NEXT_DATE)
    return _FORECASTS[id(fp)]


def q_rf_forecast(spark, d):
    return forecast(spark, d).next_day_products()


def q_rf_metrics(spark, d):
    return forecast(spark, d).metrics()


def q_rf_importance(spark, d):
    return forecast(spark, d).importance()


def q_rf_oob(spark, d):
    return forecast(spark, d).oob_r2()


def q_daily_pred(spark, d):
    return forecast(spark, d).daily_predicted()


def q_history_series(spark, d):
    return forecast(spark, d).history_series()


def q_kpi_row(spark, d):
    return forecast(spark, d).kpi_row()


def q_rf_last_row_forecast(spark, d):
    return forecast(spark, d).last_row_forecast()


def q_rf_test_pairs(spark, d):
    return forecast(spark, d).test_pairs()


ML_CATALOG = {
    "rf_last_row_forecast": q_rf_last_row_forecast,
    "rf_test_pairs": q_rf_test_pairs,
    "rf_forecast": q_rf_forecast,
    "rf_metrics": q_rf_metrics,
    "rf_importance": q_rf_importance,
    "rf_oob": q_rf_oob,
    "daily_pred": q_daily_pred,
    "history_series": q_history_series,
    "kpi_row": q_kpi_row,
}
