"""Report queries over the per-product forecast frame (Y1-Y10, M6 shape).

``product_frame`` builds the 18-field product rows from the feature fact: the
last line of each material (W7), the master labels (J11) and a score column
(the model's prediction, or any per-material score). The other functions are
the report views: search, top-k, category summary, product history,
drill-down row and formatted table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import calendar as cal
from tillcast.functions.numeric import col_
from tillcast.operators.joins import BROADCAST_MAX_BYTES, checked_broadcast, estimated_bytes, join_checked, with_scalars
from tillcast.operators.stage import stage

# Labels used when a material has no master row (fixed values).
UNKNOWN_LABEL = "Unknown"
# Report formatting (fixed values).
CURRENCY = "₹"
SEASONAL_MARK, NOT_SEASONAL_MARK = "✅", "—"
TOP_K = 15
SORTABLE = ("predicted_sale", "predicted_qty", "avg_price", "seasonal_lift", "soh")
SEASON_FILTER = {"All": None, "In-Season Only": 1, "Off-Season Only": 0}
RAIN_MARK, DRY_MARK = "🌧️", "☀️"
SEASON_MARKS = {"Summer": "🔥", "SouthWest_Monsoon": "🌧️", "NorthEast_Monsoon": "🌦️", "Winter": "❄️"}
# Labels of the product table, in order (fixed values).
TABLE_LABELS = {"material_no": "Mat No", "category": "Category", "mat_description": "Material Description",
                "predicted_sale": "Pred Sale (₹)", "predicted_qty": "Pred Qty", "avg_price": "Avg Price (₹)",
                "last_actual": "Last Actual (₹)", "avg_sale": "Avg Sale (₹)", "soh": "SOH", "indent": "Indent",
                "seasonal_lift": "Seasonal Lift", "is_seasonal": "In Season", "season": "Season",
                "traffic_index": "Traffic Index", "vendor": "Vendor"}


def round2(c) -> Column:
    """Two-decimal rounding of the binary value (x*100 rounded, /100)."""
    return F.round(col_(c) * 100.0, 0) / 100.0


def last_rows(features: DataFrame, material: str | None, order_cols: list[str] | tuple, address: str | None = None) -> DataFrame:
    """Last line of each material in (date, tie-break) order (W7), or of the
    whole table without ``material``.

    Only the first order column is aggregated over all lines (a hash aggregate,
    combined before the shuffle); the lines that have it are fetched by a join. Of those
    the last by the other order columns is taken, before the shuffle where
    a task holds several; all other columns are the tie-break, so exactly one
    line is left however many tie.

    With ``address``, a column of staged lines that numbers them, only the address
    goes through that join where it needs a shuffle; the wide lines are picked by
    a bitmap of the addresses found (a bit a line)."""
    first = f"`{order_cols[0]}`"
    keyed = [f"`{material}`"] if material else []
    f = features.where(F.col(material).isNotNull()) if material else features
    top = f.groupBy(*keyed).agg(F.max(first).alias("_last"))
    if material:
        top = top.withColumnRenamed(material, "_of")
        on = (F.col(f"`{material}`") == F.col("_of")) & F.col(first).eqNullSafe(F.col("_last"))
        if address and estimated_bytes(features) > BROADCAST_MAX_BYTES:
            near = picked(f, f.select(*keyed, first, address).join(top, on).select(address), address)
        else:
            near = f.join(checked_broadcast(top), on)
    else:
        near = with_scalars(f, top, ["_last"]).where(F.col(first).eqNullSafe(F.col("_last")))
    every = [f"`{c}`" for c in features.columns]
    w = Window.partitionBy(*keyed or [F.lit(0)]).orderBy(*[F.desc(f"`{c}`") for c in order_cols], F.desc(F.struct(*[c for c in every if c.strip("`") not in order_cols])))
    return near.select(*every, F.row_number().over(w).alias("_nth")).where("_nth = 1").select(*every)


def picked(df: DataFrame, found: DataFrame, address: str) -> DataFrame:
    """The rows of ``df`` whose address is in ``found``, without a shuffle of ``df``
    as long as the bitmap of the addresses is small enough to be broadcast."""
    bits = stage(found.groupBy(F.bitmap_bucket_number(address).alias("_bucket"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position(address)).alias("_bits")), "addresses")
    f = join_checked(df.withColumn("_bucket", F.bitmap_bucket_number(address)), bits, "_bucket", "inner")
    place = F.bitmap_bit_position(address)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return f.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).select(*[f"`{c}`" for c in df.columns])


def next_day_context(spark, next_date: str, weather_row: DataFrame) -> DataFrame:
    """One row: the forecast day's calendar, season, traffic and festive values."""
    d = _dt.date.fromisoformat(next_date)
    ctx = weather_row.select("*", F.lit(d).alias("next_date"))
    dow = F.weekday(F.col("next_date"))
    mon = F.month(F.col("next_date"))
    msin, mcos = cal.cyclic(mon, 12)
    return ctx.select(
        "*",
        dow.alias("next_dow"), mon.alias("next_month"),
        cal.season_code(mon).alias("next_season_code"), cal.season_name(mon).alias("next_season"),
        msin.alias("next_month_sin"), mcos.alias("next_month_cos"),
        cal.traffic_index(dow, F.col("w_is_rainy")).alias("next_traffic"),
        cal.delay_index(dow, F.col("w_is_rainy")).alias("next_delay"),
        cal.is_festive(mon, F.dayofmonth(F.col("next_date"))).alias("next_festive"))


def forecast_day_context(weather_ctx: DataFrame, next_date: str) -> DataFrame:
    """Y2: one row with the weather means, per-city temperatures, and the
    forecast day's season, traffic, delay and festive flag."""
    w = weather_ctx.select(F.col("temperature").alias("w_temperature"), F.col("humidity").alias("w_humidity"),
                           F.col("wind_speed").alias("w_wind_speed"), F.col("rain_1h").alias("w_rain_1h"),
                           F.col("is_rainy").alias("w_is_rainy"), F.col("heat_index").alias("w_heat_index"),
                           "city_temps")
    return next_day_context(w.sparkSession, next_date, w)


def next_day_rows(last: DataFrame, ctx: DataFrame, qty: str, soh: str) -> DataFrame:
    """The last line of each material with the 20 forecast-day overrides
    (P23); every other column stays as on the last line (Q6)."""
    q, p = F.col(qty), F.col("PricePerUnit")
    f = with_scalars(last, ctx, [c for c in ctx.columns if c.startswith("next_")])
    over = {
        "TempXQty": F.col("w_temperature") * q, "TempXPrice": F.col("w_temperature") * p,
        "HumidXQty": F.col("w_humidity") * q, "RainXQty": F.col("w_rain_1h") * q,
        "TrafficIndex": F.col("next_traffic"), "DeliveryDelayIndex": F.col("next_delay"),
        "TrafficXQty": F.col("next_traffic") * q, "TrafficXPrice": F.col("next_traffic") * p,
        "Month": F.col("next_month"), "SeasonCode": F.col("next_season_code"),
        "Month_sin": F.col("next_month_sin"), "Month_cos": F.col("next_month_cos"),
        "IsFestive": F.col("next_festive"), "Stock_Demand": F.col(soh) - q,
    }
    # the six weather scalars already hold the current weather on every line
    return f.withColumns(over)


def refreshed_lags(rows: DataFrame, state: DataFrame, dow_means: DataFrame, global_mean: DataFrame, qty: str) -> DataFrame:
    """Next-day rows whose daily lags are those of the forecast day (Q6, an option; the
    original leaves them as on the last line): ``state`` is the one row of
    :func:`series.advanced_to`, ``dow_means`` the mean day total by day of week."""
    q, p = F.col(qty), F.col("PricePerUnit")
    names = [c for c in state.columns if c != "forecast_day"]
    s = with_scalars(state, global_mean, ["global_mean"]).withColumn("DayOfWeek", F.weekday("forecast_day"))
    s = s.join(F.broadcast(dow_means), "DayOfWeek", "left")  # seven rows at most
    s = s.select(*[F.col(c).alias(f"_n_{c}") for c in names], F.coalesce("DOW_AvgDailyTotal", "global_mean").alias("_n_dow"))
    f = with_scalars(rows, s)
    new = {c: F.col(f"_n_{c}") for c in names}
    prev, roll3, roll7 = new["PrevDayTotalSale"], new["DailyRoll3"], new["DailyRoll7"]
    new |= {"DailyMomentum": prev - roll3, "DailyTrend3v7": F.try_divide(roll3, roll7 + 1),
            "PrevDayXPrice": prev * p, "PrevDayXQty": prev * q, "DailyRoll3XQty": roll3 * q, "DailyRoll3XPrice": roll3 * p,
            "DailyEWM3XQty": new["DailyEWM3"] * q, "DOW_AvgDailyTotal": F.col("_n_dow"),
            "SaleVsDOWTotal": F.try_divide(prev, F.col("_n_dow") + 1)}
    return f.withColumns(new).drop(*[c for c in f.columns if c.startswith("_n_")])


def product_frame(last: DataFrame, meta: DataFrame, score: DataFrame, ctx: DataFrame,
                  material: str, value: str, qty: str, soh: str, indent: str,
                  score_col: str = "score") -> DataFrame:
    """M6 output fields, one row per material. ``score`` is (material, score)."""
    f = (last.join(score, material, "left")
         .join(meta.withColumn("_meta_hit", F.lit(1)), material, "left"))
    f = with_scalars(f, ctx, ["next_season", "next_festive", "next_traffic", "next_delay"])
    hit = F.col("_meta_hit").isNotNull()
    avg_price = F.col("Mat_AvgPrice")
    pred = F.col(score_col)
    pred_qty = F.when(avg_price > 0, pred / avg_price).otherwise(F.lit(0.0))
    return f.select(
        F.col(material).alias("material_no"),
        F.when(hit, F.col("display_name")).otherwise(F.col(material).cast("string")).alias("display_name"),
        F.when(hit, F.col("category_label")).otherwise(F.lit(UNKNOWN_LABEL)).alias("category"),
        F.when(hit, F.col("mat_description")).otherwise(F.col(material).cast("string")).alias("mat_description"),
        F.when(hit, F.col("vendor_name")).otherwise(F.lit(UNKNOWN_LABEL)).alias("vendor"),
        round2(pred).alias("predicted_sale"),
        round2(F.greatest(pred_qty, F.lit(0.0))).alias("predicted_qty"),
        round2(avg_price).alias("avg_price"),
        round2(F.col(value).cast("double")).alias("last_actual"),
        round2(F.col("Mat_AvgSale")).alias("avg_sale"),
        F.col("next_season").alias("season"),
        F.col("IsSeasonalProduct").cast("long").alias("is_seasonal"),
        round2(F.col("SeasonalLift")).alias("seasonal_lift"),
        round2(F.col(soh)).alias("soh"),
        round2(F.col(indent)).alias("indent"),
        F.col("next_festive").cast("long").alias("is_festive_day"),
        round2(F.col("next_traffic")).alias("traffic_index"),
        round2(F.col("next_delay")).alias("delay_index"),
    )


def search_products(products: DataFrame, text: str | None = None, category: str = "All",
                    in_season: str = "All", sort_by: str = "predicted_sale",
                    literal: bool = False) -> DataFrame:
    """Case-insensitive search over three labels (a regular expression
    like the reference, or plain text with ``literal``), category and season
    filters, sort descending by an allowed column."""
    f = products
    if text:
        if literal:
            pat = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
            hit = [F.col(c).ilike(pat) for c in ("display_name", "category", "mat_description")]
        else:
            hit = [F.col(c).rlike("(?i)" + text) for c in ("display_name", "category", "mat_description")]
        f = f.where(F.coalesce(hit[0] | hit[1] | hit[2], F.lit(False)))
    if category != "All":
        f = f.where(F.col("category") == F.lit(category))
    if in_season not in SEASON_FILTER:
        raise ValueError(f"in_season must be one of {tuple(SEASON_FILTER)}")
    if SEASON_FILTER[in_season] is not None:
        f = f.where(F.col("is_seasonal") == F.lit(SEASON_FILTER[in_season]))
    if sort_by not in SORTABLE:
        raise ValueError(f"sort_by must be one of {SORTABLE}")
    return f.orderBy(F.desc_nulls_last(sort_by), F.col("material_no"))


def shown_counts(products: DataFrame, **filters) -> DataFrame:
    """One row: how many products the filters show, of how many."""
    shown = search_products(products, **filters).agg(F.count(F.lit(1)).alias("shown"))
    return with_scalars(shown, products.agg(F.count(F.lit(1)).alias("total")))


def top_products(products: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k products with the largest forecast (a top-k report), with the text of their bars."""
    top = products.orderBy(F.desc_nulls_last("predicted_sale"), F.col("material_no")).limit(k)
    return top.withColumn("bar_text", rupees("predicted_sale", 0))


def category_summary(products: DataFrame) -> DataFrame:
    """Per category total forecast, product count, mean lift; largest first."""
    return (products.groupBy("category").agg(
        F.sum("predicted_sale").alias("total_predicted"),
        F.count(F.lit(1)).alias("n_products"),
        F.avg("seasonal_lift").alias("mean_lift"))
        .orderBy(F.desc("total_predicted"), "category"))


def category_list(products: DataFrame) -> DataFrame:
    """Sorted distinct categories (the caller adds 'All')."""
    return products.select("category").distinct().orderBy("category")


def product_row(products: DataFrame, name: Column | str) -> DataFrame:
    """First product with this display name in forecast order."""
    hit = products.where(F.col("display_name") == (name if isinstance(name, Column) else F.lit(name)))
    return hit.orderBy(F.desc_nulls_last("predicted_sale"), "material_no").limit(1)


def product_history(fact: DataFrame, row: DataFrame, material: str, date: str, value: str, next_date: str) -> DataFrame:
    """Of the product in the one-row frame ``row``: its daily sales, the
    line of its average, and the forecast point, as (series, invoice_date, value)."""
    mine = fact.where(F.col(material) == row.select("material_no").scalar())
    daily = mine.groupBy(date).agg(F.sum(value).cast("double").alias("value"))
    parts = [daily.select(F.lit("actual").alias("series"), F.col(date).cast("timestamp_ntz").alias("invoice_date"), "value"),
             row.select(F.lit("average"), F.lit(None).cast("timestamp_ntz"), "avg_sale"),
             row.select(F.lit("forecast"), F.to_timestamp_ntz(F.lit(next_date)), "predicted_sale")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def rupees(c, digits: int = 2) -> Column:
    return F.concat(F.lit(CURRENCY), F.format_number(col_(c), digits))


def format_report(products: DataFrame) -> DataFrame:
    """P24 + C13, C14: the product table, its fifteen columns as display text."""
    p = {c: F.col(c) for c in TABLE_LABELS}
    p |= {c: rupees(c) for c in ("predicted_sale", "avg_price", "last_actual", "avg_sale")}
    p |= {c: F.format_number(F.col(c), 1) for c in ("predicted_qty", "soh", "indent")}
    p["seasonal_lift"] = F.concat(F.format_string("%.2f", F.col("seasonal_lift")), F.lit("×"))
    p["traffic_index"] = F.format_string("%.2f", F.col("traffic_index"))
    p["is_seasonal"] = F.when(F.col("is_seasonal") == 1, SEASONAL_MARK).otherwise(NOT_SEASONAL_MARK)
    return products.select(*[p[c].alias(label) for c, label in TABLE_LABELS.items()])


def day_labels(ctx: DataFrame) -> DataFrame:
    """C12, C14, C15 of the forecast day in the one-row context: season and rain
    marks, the season's name as text, and the day in the report's three forms."""
    season = F.col("next_season")
    marks = F.create_map(*[F.lit(x) for kv in SEASON_MARKS.items() for x in kv])
    return ctx.select(F.regexp_replace(season, "_", " ").alias("season_label"), marks[season].alias("season_mark"),
                      F.when(F.col("w_is_rainy") == 1, RAIN_MARK).otherwise(DRY_MARK).alias("rain_mark"),
                      F.date_format("next_date", "dd MMM yyyy").alias("forecast_day"), F.date_format("next_date", "dd MMM").alias("short_day"),
                      F.date_format("next_date", "yyyyMMdd").alias("file_day"))


def kpi_texts(kpi: DataFrame) -> DataFrame:
    """The figures of the summary as the cards show them."""
    fixed = lambda c: F.format_string("%.4f", F.col(c))
    return kpi.select(rupees("total_forecast", 0).alias("total_forecast_txt"), fixed("test_r2").alias("test_r2_txt"),
                      fixed("train_r2").alias("train_r2_txt"), rupees("rmse", 0).alias("rmse_txt"), rupees("mae", 0).alias("mae_txt"),
                      "n_rows", "n_train", "n_test")
