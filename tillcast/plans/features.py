"""The feature plan: cleaned, joined invoice lines widened to the 141 model
features (SURVEY 2.12), as DataFrame expressions.

Shape of the plan (per statistic key one grouped pass and one join back):

    sales -> clean -> left joins (J1-J3) -> fills (P8, P9) -> row features
      M   per material: stats, medians, day-of-week and season sums (one pass)
      K/C/V/N per SKU / Category / VENDOR / Short Name, with label codes
      D   per day: totals, previous calendar day, rolling and EWM means
      G   one row of global scalars; W one row of weather context
      ranks: value histograms with prefix counts
    fact JOIN M, K, C, V, N, D, ranks, codes; CROSS JOIN broadcast(G, W)

Small tables (G, W, 7-row day-of-week means) are broadcast explicitly because
their size is fixed; the other joins are left to AQE, which broadcasts a
table that is small at run time and splits skewed partitions otherwise.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.columns import SalesColumns
from tillcast.functions import calendar as cal
from tillcast.functions.numeric import log1p_, row_mean_skip_null, safe_div, safe_qty
from tillcast.operators import joins, series, stats
from tillcast.operators.clean import clean_sales, split_valid
from tillcast.operators.enrich import enrich_joins, fill_defaults, median_or_zero, product_meta, soh_median
from tillcast.operators.ordered import exact_medians, label_codes, pct_ranks
from tillcast.operators.joins import estimated_bytes, join_checked, with_scalars
from tillcast.operators.stage import part, stage, stage_result
from tillcast.plans.reports import last_rows
from tillcast.session import compiled
from tillcast.sources.sheets import Sheets

# ---- fixed values: the 141 features in matrix order ---------
FEATURES = [
    'SalQty', 'PricePerUnit', 'QtyXPrice',
    'Log_SalQty', 'Log_Price', 'Log_QtyXPrice', 'Sqrt_QtyXPrice',
    'SOH', 'Indent', 'StockPressure', 'StockCoverage', 'IndentRatio', 'Stock_Demand',
    'Mat_AvgSale', 'Mat_MedSale', 'Mat_MaxSale', 'Mat_MinSale', 'Mat_StdSale',
    'Mat_SumSale', 'Mat_Count', 'Mat_AvgQty', 'Mat_AvgPrice', 'Mat_MedPrice',
    'Mat_SaleRange', 'Mat_SaleNorm', 'Mat_FreqWeight',
    'QtyXMatAvgPrice', 'QtyXMatMedPrice', 'ResidFromMat', 'PriceVsMatAvg',
    'QtyVsMatAvg', 'Log_QtyXMatAvg', 'Sale_MatZscore',
    'TE_LOO_Mat', 'TE_Smooth_Mat', 'QtyXTESmooth',
    'SKU_AvgSale', 'SKU_MedSale', 'SKU_MaxSale', 'SKU_SumSale',
    'SKU_AvgQty', 'SKU_AvgPrice', 'SKU_Count',
    'Category_AvgSale', 'Category_MedSale', 'Category_MaxSale',
    'Category_SumSale', 'Category_AvgQty', 'Category_AvgPrice',
    'VENDOR_AvgSale', 'VENDOR_SumSale', 'VENDOR_AvgPrice',
    'Cat_AvgPrice',
    'QtyXSKUAvgPrice', 'QtyXCatAvgPrice', 'QtyXCatWAvgPrice',
    'ResidFromSKU', 'ResidFromCat', 'SaleVsSKURatio', 'SaleVsCatRatio',
    'PriceDevSKU', 'Cat_WAvgPrice', 'TE_LOO_SKU',
    'ReconEnsemble', 'ResidFromRecon', 'Log_ReconEns', 'ExactPriceDev', 'QtyXPriceDev',
    'DayOfWeek', 'DayOfMonth', 'IsWeekend', 'DaysSinceStart', 'DOW_sin', 'DOW_cos',
    'Mat_DOW_AvgSale', 'QtyXMatDOWAvg', 'TE_Smooth_MatDOW', 'QtyXTE_MatDOW',
    'PrevDayTotalSale', 'PrevDayTotalQty', 'PrevDayRowCount',
    'DailyRoll2', 'DailyRoll3', 'DailyRoll5', 'DailyRoll7', 'DailyEWM3', 'DailyEWM5',
    'DailyMomentum', 'DailyTrend3v7',
    'DateLOO_Sale', 'DateLOO_Qty', 'DateLOO_Mean',
    'PrevDayXPrice', 'PrevDayXQty', 'DailyRoll3XQty', 'DailyRoll3XPrice', 'DailyEWM3XQty',
    'SaleVsDateTotal', 'DOW_AvgDailyTotal', 'SaleVsDOWTotal',
    'SN_AvgSale', 'SN_SumSale', 'SN_AvgPrice', 'SN_AvgQty', 'QtyXSNAvgPrice', 'ResidFromSN',
    'SalQty_rank', 'Price_rank', 'MatAvg_rank', 'QtyXPrice_rank',
    'Category', 'SKU', 'VENDOR', 'TYPE', 'Short Name', 'Material name',
    'Temperature', 'WindSpeed', 'TempXQty', 'TempXPrice',
    'Humidity', 'Rain_1h', 'IsRainy', 'HeatIndex', 'HumidXQty', 'RainXQty',
    'TrafficIndex', 'DeliveryDelayIndex', 'TrafficXQty', 'TrafficXPrice',
    'Month', 'SeasonCode', 'Month_sin', 'Month_cos',
    'IsFestive', 'IsSeasonalProduct', 'SeasonalLift',
    'Mat_SeasonAvgSale', 'SeasonalXQty', 'SeasonalLiftXQty', 'FestiveXQty',
]
# Smoothing strengths of the target encodings (fixed values).
ALPHA_MAT, ALPHA_MAT_DOW = 5.0, 3.0
FACT_ROUNDS = 4   # parts of the materials whose lines are shuffled one after another
# ---------------------------------------------------------------------------

# Label-coded features live beside their text in columns of these names.
CODE_COLUMNS = {'Category': 'Category_code', 'SKU': 'SKU_code', 'VENDOR': 'VENDOR_code',
                'TYPE': 'TYPE_code', 'Short Name': 'ShortName_code',
                'Material name': 'MaterialName_code'}
# Weather scalars carry a prefix in the fact (names would clash case-insensitively).
WEATHER_COLUMNS = {'Temperature': 'w_temperature', 'Humidity': 'w_humidity',
                   'WindSpeed': 'w_wind_speed', 'Rain_1h': 'w_rain_1h', 'IsRainy': 'w_is_rainy',
                   'HeatIndex': 'w_heat_index'}


def feature_column(name: str, cols: SalesColumns) -> str:
    """Fact column holding feature ``name``."""
    if name in CODE_COLUMNS:
        return CODE_COLUMNS[name]
    if name in WEATHER_COLUMNS:
        return WEATHER_COLUMNS[name]
    return {'SalQty': cols.qty, 'SOH': cols.soh, 'Indent': cols.indent}.get(name, name)


V = "_v"  # sale value as double on each row


class FeaturePlan:
    """Lazily built DataFrames of the feature pipeline for one set of sheets.

    ``weather`` is the one-row frame of :func:`weather_context` (defaults when
    None). Properties return plans, not data; nothing runs until an action.
    """

    def __init__(self, sheets: Sheets, weather: DataFrame | None = None,
                 dedup_masters: bool = False, with_medians: bool = True,
                 staged: bool = True, legacy_nan_text: bool = False):
        self.staged = staged
        self.sheets = sheets
        self.cols = sheets.cols
        self.weather = weather
        self.dedup_masters = dedup_masters
        self.legacy_nan_text = legacy_nan_text   # Q1: a missing text is the text 'nan'
        self.with_medians = with_medians
        compiled(sheets.sales.sparkSession)

    # ---- stage 1: clean, join, fill, row features -------------------------
    @cached_property
    def _valid(self) -> tuple[DataFrame, DataFrame]:
        c = self.cols
        return split_valid(clean_sales(self.sheets.sales, c.date, c.qty, self.legacy_nan_text), c.value, c.date)

    @property
    def sales(self) -> DataFrame:
        return self._valid[0]

    @property
    def quarantine(self) -> DataFrame:
        """Lines that cannot be used, with the reason; count them before use."""
        return self._valid[1]

    @cached_property
    def joined(self) -> DataFrame:
        s = self.sheets
        return enrich_joins(self.sales, s.sku_buy, s.indent, s.crt_size, self.cols, self.dedup_masters, self.legacy_nan_text)

    @cached_property
    def _staged_joined(self) -> DataFrame:
        """The joined lines, staged once, each with an address (``_row``) that holds as
        it is written. What a line's own columns give is not written."""
        return stage(self.joined.withColumn("_row", F.monotonically_increasing_id()), "base")

    @cached_property
    def median_soh(self) -> DataFrame:
        """One row: the stock fill, from the stock of the staged lines (few different
        values, counted before the shuffle), so that the lines are joined only once."""
        s = self.sheets
        if self.staged:
            return self._stage(lambda: median_or_zero(self._staged_joined, self.cols.soh), "median-soh")
        return self._stage(lambda: soh_median(self.sales, s.sku_buy, s.indent, s.crt_size, self.cols, self.dedup_masters), "median-soh")

    @cached_property
    def filled(self) -> DataFrame:
        return self.lines.drop("_row") if self.staged else fill_defaults(self.joined, self.cols, self.median_soh)

    @cached_property
    def meta(self) -> DataFrame:
        return product_meta(self.sheets.sku_buy)

    def _stage(self, build, name: str, by: str | None = None) -> DataFrame:
        """``build()`` staged, without the tables that were staged on the way to it."""
        return stage_result(build, name, by) if self.staged else build()

    @cached_property
    def lines(self) -> DataFrame:
        """Filled lines; staged ones with their address, filled as they are read."""
        if not self.staged:
            return self.filled
        f = fill_defaults(self._staged_joined, self.cols, self.median_soh)
        f = f.select(*[f"`{c}`" for c in f.columns if c != "_row"], "_row")
        f._staged_path = self._staged_joined._staged_path
        return f

    @cached_property
    def base(self) -> DataFrame:
        """Filled lines + price, stock and calendar columns."""
        return self.row_features(self.lines)

    @cached_property
    def last_lines(self) -> DataFrame:
        """The last line of each material (W7), staged, with the columns of ``base``:
        found among the lines as they are staged, before anything is joined to them."""
        c = self.cols
        return self.row_features(self._stage(lambda: last_rows(self.lines, c.material, c.order, "_row" if self.staged else None), "last-lines"))

    def row_features(self, lines: DataFrame) -> DataFrame:
        """Lines + price, stock and calendar columns (F1-F13, F69-F71, F131-F135)."""
        c = self.cols
        q, dt = F.col(c.qty), F.col(c.date)
        soh, ind = F.col(c.soh), F.col(c.indent)
        address = [x for x in lines.columns if x == "_row"]
        f = lines.withColumn(V, F.col(c.value).cast("double"))
        p = F.col(V) / safe_qty(q)
        f = f.withColumn("PricePerUnit", p)
        p = F.col("PricePerUnit")
        qp = q * p
        dow_sin, dow_cos = cal.cyclic(cal.weekday(dt), 7)
        mon_sin, mon_cos = cal.cyclic(F.month(dt), 12)
        return f.select(
            *[f"`{x}`" for x in f.columns if x not in address],
            qp.alias("QtyXPrice"),
            log1p_(q).alias("Log_SalQty"),
            log1p_(p).alias("Log_Price"),
            log1p_(qp).alias("Log_QtyXPrice"),
            F.sqrt(F.abs(qp)).alias("Sqrt_QtyXPrice"),
            safe_div(q, soh + 1).alias("StockPressure"),
            safe_div(soh, q + 1).alias("StockCoverage"),
            safe_div(ind, soh + 1).alias("IndentRatio"),
            (soh - q).alias("Stock_Demand"),
            cal.weekday(dt).alias("DayOfWeek"),
            F.dayofmonth(dt).alias("DayOfMonth"),
            cal.weekday(dt).isin(5, 6).cast("int").alias("IsWeekend"),
            dow_sin.alias("DOW_sin"), dow_cos.alias("DOW_cos"),
            F.month(dt).alias("Month"),
            cal.season_code(F.month(dt)).alias("SeasonCode"),
            mon_sin.alias("Month_sin"), mon_cos.alias("Month_cos"),
            cal.is_festive(F.month(dt), F.dayofmonth(dt)).alias("IsFestive"),
            *address,
        )

    # ---- statistic tables --------------------------------------------------
    MEDIANS = (("Mat_MedSale", "material", "value"), ("Mat_MedPrice", "material", "PricePerUnit"),
               ("SKU_MedSale", "sku", "value"), ("Category_MedSale", "category", "value"))
    CODES = (("Category_code", "category"), ("SKU_code", "sku"), ("VENDOR_code", "vendor"),
             ("TYPE_code", "type"), ("ShortName_code", "short_name"), ("MaterialName_code", "material_name"))

    def _col(self, role: str) -> str | None:
        if role == "PricePerUnit":
            return role
        return getattr(self.cols, role, None)

    @cached_property
    def medians(self) -> DataFrame:
        """All exact medians of the plan in one histogram pass (staged)."""
        specs = [(n, self._col(k), self._col(v)) for n, k, v in self.MEDIANS if self._col(k)]
        return self._stage(lambda: exact_medians(self.base, specs), "medians", "_stat")

    def median_table(self, name: str, key: str) -> DataFrame:
        kt = self.base.schema[key].dataType
        return (part(self.medians, "_stat", name)
                .select(F.col("_key").cast(kt).alias(key), F.col("median").alias(name)))

    @cached_property
    def codes(self) -> DataFrame:
        """All label codes in one pass over the distinct texts (staged)."""
        specs = [(n, self._col(c)) for n, c in self.CODES if self._col(c)]
        return self._stage(lambda: label_codes(self.base, specs), "codes", "_cn")

    def code_table(self, name: str, col: str) -> DataFrame:
        return (part(self.codes, "_cn", name).where(F.col("_val").isNotNull())
                .select(F.col("_val").alias(col), F.col("code").alias(name)))

    def missing_codes(self) -> DataFrame:
        """One row: the code that a missing text has in each encoded column."""
        return self.codes.where(F.col("_val").isNull()).agg(
            *[F.max(F.when(F.col("_cn") == n, F.col("code"))).alias(f"_missing_{n}") for n, c in self.CODES if self._col(c)])

    @cached_property
    def ranks(self) -> DataFrame:
        """All four percent ranks in one pass (staged); MatAvg_rank is
        weighted by each material's line count (a rank over lines)."""
        c = self.cols
        parts = [(self.base, [("SalQty_rank", c.qty, None), ("Price_rank", "PricePerUnit", None), ("QtyXPrice_rank", "QtyXPrice", None)]),
                 (self.M_stats, [("MatAvg_rank", "Mat_AvgSale", "_Mat_rows")])]
        return self._stage(lambda: pct_ranks(parts), "ranks", "_rk")

    def rank_table(self, name: str, col: str) -> DataFrame:
        return (part(self.ranks, "_rk", name)
                .select(F.col("_x").alias(col), F.col("pct").alias(name)))

    @cached_property
    def M(self) -> DataFrame:
        return join_checked(self.M_stats, self.rank_table("MatAvg_rank", "Mat_AvgSale"), "Mat_AvgSale")

    @cached_property
    def M_stats(self) -> DataFrame:
        """Per material, one grouped pass: A1 stats, the per day-of-week and
        per season sums and counts (A6, A10) as 7- and 4-slot arrays, exact
        medians, and the row-weighted percent rank of the mean (W1)."""
        c = self.cols
        val = F.col(c.value)
        extra = [
            F.array(*[F.sum(F.when(F.col("DayOfWeek") == d, val)).cast("double") for d in range(7)]).alias("_md_sum"),
            F.array(*[F.count(F.when(F.col("DayOfWeek") == d, val)) for d in range(7)]).alias("_md_cnt"),
            F.array(*[F.sum(F.when(F.col("SeasonCode") == s, val)).cast("double") for s in range(4)]).alias("_ms_sum"),
            F.array(*[F.count(F.when(F.col("SeasonCode") == s, val)) for s in range(4)]).alias("_ms_cnt"),
        ]
        st = ("AvgSale", "MedSale", "MaxSale", "MinSale", "StdSale", "SumSale", "Count",
              "AvgQty", "AvgPrice", "MedPrice") if self.with_medians else \
            ("AvgSale", "MaxSale", "MinSale", "StdSale", "SumSale", "Count", "AvgQty", "AvgPrice")
        meds = {n: self.median_table(n, c.material) for n in ("Mat_MedSale", "Mat_MedPrice")} \
            if self.with_medians else {}
        return self._stage(lambda: stats.group_stats(self.base, c.material, "Mat", c.value, c.qty, "PricePerUnit", st, extra, meds), "material")

    def _keyed(self, key: str | None, prefix: str, st: tuple,
               extra: list[Column] | None = None) -> DataFrame | None:
        if not key:
            return None
        if not self.with_medians:
            st = tuple(s for s in st if s not in ("MedSale", "MedPrice"))
        meds = {f"{prefix}_MedSale": self.median_table(f"{prefix}_MedSale", key)} \
            if "MedSale" in st else {}
        return self._stage(lambda: stats.group_stats(self.base, key, prefix, self.cols.value, self.cols.qty,
                                                     "PricePerUnit", st, extra, meds), prefix)

    @cached_property
    def K(self) -> DataFrame:
        return self._keyed(self.cols.sku, "SKU", ("AvgSale", "MedSale", "MaxSale", "SumSale",
                                                 "AvgQty", "AvgPrice", "Count"))

    @cached_property
    def C(self) -> DataFrame:
        p, q = F.col("PricePerUnit"), F.col(self.cols.qty)
        wavg = F.try_divide(F.coalesce(F.sum(p * q), F.lit(0.0)),
                            F.coalesce(F.sum(q), F.lit(0.0)) + 1).alias("Cat_WAvgPrice")
        return self._keyed(self.cols.category, "Category",
                           ("AvgSale", "MedSale", "MaxSale", "SumSale", "AvgQty", "AvgPrice", "Count"),
                           [wavg])

    @cached_property
    def V(self) -> DataFrame:
        return self._keyed(self.cols.vendor, "VENDOR", ("AvgSale", "SumSale", "AvgPrice"))

    @cached_property
    def N(self) -> DataFrame | None:
        return self._keyed(self.cols.short_name, "SN", ("AvgSale", "SumSale", "AvgPrice", "AvgQty"))

    @cached_property
    def G(self) -> DataFrame:
        """One row: global mean of the target, first date, row count, largest
        material count (A11)."""
        c = self.cols
        g = self.base.agg(stats.exact_mean(c.value).alias("global_mean"),
                          F.min(c.date).alias("min_date"),
                          F.count(F.lit(1)).alias("row_count"))
        counts = (self.base.where(F.col(c.material).isNotNull()).groupBy(c.material)
                  .agg(F.count(c.value).alias("_n")))
        mx = counts.agg(F.max("_n").alias("max_mat_count"))
        return self._stage(lambda: with_scalars(g, mx, ["max_mat_count"]), "global")

    @cached_property
    def daily(self) -> DataFrame:
        c = self.cols
        return series.daily_totals(self.base, c.date, c.value, c.qty, c.series_keys)

    @cached_property
    def D(self) -> DataFrame:
        """Per day: totals, previous calendar day, rolling/EWM means of earlier
        observed days, momentum and trend, mean total of its day of week."""
        return self._stage(self._days, "daily")

    def _days(self) -> DataFrame:
        c = self.cols
        keys = list(c.series_keys)
        d = series.with_day_index(self.daily, c.date, keys)
        d = series.prev_calendar_day(d, c.date, keys)
        d = series.earlier_day_means(d, keys=keys)
        dow = series.dow_average_total(self.daily, c.date, keys=keys)
        if not keys:
            dow = F.broadcast(dow)   # at most 7 rows
        d = d.withColumn("DayOfWeek", F.weekday(c.date)).join(dow, keys + ["DayOfWeek"], "left")
        return d.select(
            *keys, c.date, "day_idx", "day_total", "day_qty", "day_count",
            "PrevDayTotalSale", "PrevDayTotalQty", "PrevDayRowCount",
            "DailyRoll2", "DailyRoll3", "DailyRoll5", "DailyRoll7", "DailyEWM3", "DailyEWM5",
            (F.col("PrevDayTotalSale") - F.col("DailyRoll3")).alias("DailyMomentum"),
            safe_div(F.col("DailyRoll3"), F.col("DailyRoll7") + 1).alias("DailyTrend3v7"),
            F.col("DOW_AvgDailyTotal").alias("_dow_avg_total"))

    @cached_property
    def weather_row(self) -> DataFrame:
        """One-row weather context with the fact's column names."""
        if self.weather is None:
            from tillcast.sources import weather as w
            ctx = self.base.sparkSession.range(1).select(
                F.lit(w.DEFAULT_TEMP).alias("temperature"), F.lit(w.DEFAULT_HUMIDITY).alias("humidity"),
                F.lit(w.DEFAULT_WIND).alias("wind_speed"), F.lit(w.DEFAULT_RAIN).alias("rain_1h"),
                F.lit(0).alias("is_rainy"))
            ctx = ctx.withColumn("heat_index", cal.heat_index("temperature", "humidity"))
        else:
            ctx = self.weather
        return ctx.select(F.col("temperature").alias("w_temperature"),
                          F.col("humidity").alias("w_humidity"),
                          F.col("wind_speed").alias("w_wind_speed"),
                          F.col("rain_1h").alias("w_rain_1h"),
                          F.col("is_rainy").alias("w_is_rainy"),
                          F.col("heat_index").alias("w_heat_index"))

    # ---- feature groups (each adds columns to a frame that has base) -------
    def _attached(self, df: DataFrame, tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
        """``df`` with the column ``out`` of each (table, column it is joined on, out).

        Small tables are broadcast. A table of near-unique values or texts is joined
        with the narrow rows (address, value) instead, and what all such tables
        gave is brought to the wide lines by one join on the address, which no key can skew."""
        large = [t for t in tables if self.staged and estimated_bytes(t[0]) > joins.BROADCAST_MAX_BYTES]
        f = df
        for table, col, _ in tables:
            if not any(table is t for t, _, _ in large):
                f = join_checked(f, table, col)
        own = None
        for table, col, out in large:
            found = df.select("_row", col).where(F.col(col).isNotNull()).join(table, col).select("_row", out)
            own = found if own is None else own.join(found, "_row", "full_outer")
        return f if own is None else f.join(own, "_row", "left")

    def with_globals(self, df: DataFrame) -> DataFrame:
        return with_scalars(df, self.G, ["global_mean", "min_date", "max_mat_count"])

    def with_material(self, df: DataFrame) -> DataFrame:
        """F14-F36, F67-F68, F75-F78, F136-F141 (needs with_globals)."""
        return self.material_features(self._material_joined(df, self.M_stats))

    def _material_joined(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """Each line with its material's statistics, of the day-of-week and season
        slots those of its own day."""
        f = join_checked(df, table.drop("_Mat_rows"), self.cols.material)
        slot = {"_md_sum": F.col("DayOfWeek"), "_md_cnt": F.col("DayOfWeek"), "_ms_sum": F.col("SeasonCode"), "_ms_cnt": F.col("SeasonCode")}
        return f.withColumns({n: F.element_at(F.col(n), i + 1) for n, i in slot.items()})

    def material_features(self, f: DataFrame) -> DataFrame:
        """What a line and its material's statistics give (needs with_globals)."""
        q, v, p = F.col(self.cols.qty), F.col(V), F.col("PricePerUnit")
        gm = F.col("global_mean")
        md_sum, md_cnt, ms_sum, ms_cnt = (F.col(n) for n in ("_md_sum", "_md_cnt", "_ms_sum", "_ms_cnt"))
        mavg = F.col("Mat_AvgSale")
        f = f.select(
            "*",
            (F.col("Mat_MaxSale") - F.col("Mat_MinSale")).alias("Mat_SaleRange"),
            stats.minmax_norm(v, F.col("Mat_MinSale"), F.col("Mat_MaxSale")).alias("Mat_SaleNorm"),
            (F.col("Mat_Count") / F.col("max_mat_count")).alias("Mat_FreqWeight"),
            (q * F.col("Mat_AvgPrice")).alias("QtyXMatAvgPrice"),
            (q * F.col("Mat_MedPrice")).alias("QtyXMatMedPrice") if self.with_medians
            else F.lit(None).cast("double").alias("QtyXMatMedPrice"),
            (v - q * F.col("Mat_AvgPrice")).alias("ResidFromMat"),
            safe_div(p, F.col("Mat_AvgPrice") + 1).alias("PriceVsMatAvg"),
            safe_div(q, F.col("Mat_AvgQty") + 1).alias("QtyVsMatAvg"),
            log1p_(q * F.col("Mat_AvgPrice")).alias("Log_QtyXMatAvg"),
            stats.zscore(v, mavg, F.col("Mat_StdSale")).alias("Sale_MatZscore"),
            stats.leave_one_out(F.col("Mat_SumSale"), F.col("Mat_Count"), v).alias("TE_LOO_Mat"),
            stats.smooth_encode(F.col("Mat_Count"), mavg, gm, ALPHA_MAT).alias("TE_Smooth_Mat"),
            (p - F.col("Mat_AvgPrice")).alias("ExactPriceDev"),
            (q * (p - F.col("Mat_AvgPrice"))).alias("QtyXPriceDev"),
            F.coalesce(safe_div(md_sum, md_cnt), mavg).alias("Mat_DOW_AvgSale"),
            ((md_sum - v + F.lit(ALPHA_MAT_DOW) * gm) / (md_cnt - 1 + F.lit(ALPHA_MAT_DOW) + F.lit(1e-9)))
            .alias("TE_Smooth_MatDOW"),
            F.coalesce(safe_div(ms_sum, ms_cnt), mavg).alias("Mat_SeasonAvgSale"),
        )
        msa = F.col("Mat_SeasonAvgSale")
        seasonal = F.coalesce((msa > mavg).cast("int"), F.lit(0))
        lift = msa / (mavg + F.lit(1e-9))
        f = f.select(
            "*",
            safe_div(q * F.col("TE_Smooth_Mat"), F.col("Mat_AvgQty") + 1).alias("QtyXTESmooth"),
            (q * safe_div(F.col("Mat_DOW_AvgSale"), F.col("Mat_AvgQty") + 1)).alias("QtyXMatDOWAvg"),
            safe_div(q * F.col("TE_Smooth_MatDOW"), F.col("Mat_AvgQty") + 1).alias("QtyXTE_MatDOW"),
            seasonal.alias("IsSeasonalProduct"),
            lift.alias("SeasonalLift"),
            (seasonal * q).alias("SeasonalXQty"),
            (lift * q).alias("SeasonalLiftXQty"),
            (F.col("IsFestive") * q).alias("FestiveXQty"),
        )
        return f.drop("_md_sum", "_md_cnt", "_ms_sum", "_ms_cnt")

    def with_groups(self, df: DataFrame) -> DataFrame:
        """F37-F63 (SKU, Category, VENDOR) and their label codes."""
        c = self.cols
        f = join_checked(df, self.K.drop("_SKU_rows"), c.sku)
        f = join_checked(f, self.C.drop("_Category_rows"), c.category)
        f = join_checked(f, self.V.drop("_VENDOR_rows"), c.vendor)
        q, v, p = F.col(c.qty), F.col(V), F.col("PricePerUnit")
        return f.select(
            "*",
            F.col("Category_AvgPrice").alias("Cat_AvgPrice"),
            (q * F.col("SKU_AvgPrice")).alias("QtyXSKUAvgPrice"),
            (q * F.col("Category_AvgPrice")).alias("QtyXCatAvgPrice"),
            (q * F.col("Cat_WAvgPrice")).alias("QtyXCatWAvgPrice"),
            (v - q * F.col("SKU_AvgPrice")).alias("ResidFromSKU"),
            (v - q * F.col("Category_AvgPrice")).alias("ResidFromCat"),
            safe_div(v, F.col("SKU_AvgSale") + 1).alias("SaleVsSKURatio"),
            safe_div(v, F.col("Category_AvgSale") + 1).alias("SaleVsCatRatio"),
            (p - F.col("SKU_AvgPrice")).alias("PriceDevSKU"),
            stats.leave_one_out(F.col("SKU_SumSale"), F.col("SKU_Count"), v).alias("TE_LOO_SKU"),
        )

    def with_recon(self, df: DataFrame) -> DataFrame:
        """F64-F66 (needs material and group features)."""
        v = F.col(V)
        recon = row_mean_skip_null(["QtyXMatAvgPrice", "QtyXMatMedPrice", "QtyXSKUAvgPrice",
                                    "QtyXCatAvgPrice", "QtyXCatWAvgPrice", "QtyXTESmooth"])
        f = df.withColumn("ReconEnsemble", recon)
        return f.select("*", (v - F.col("ReconEnsemble")).alias("ResidFromRecon"),
                        log1p_("ReconEnsemble").alias("Log_ReconEns"))

    def with_daily(self, df: DataFrame) -> DataFrame:
        """F72, F79-F100 (needs with_globals)."""
        c = self.cols
        keys = list(c.series_keys)
        f = join_checked(df, self.D.drop("day_idx"), keys + [c.date])
        q, v, p = F.col(c.qty), F.col(V), F.col("PricePerUnit")
        prev = F.col("PrevDayTotalSale")
        days = F.floor((F.unix_micros(F.col(c.date).cast("timestamp"))
                        - F.unix_micros(F.col("min_date").cast("timestamp"))) / F.lit(86400000000))
        dow_avg = F.coalesce(F.col("_dow_avg_total"), F.col("global_mean"))
        return f.select(
            *[x for x in f.columns if x != "_dow_avg_total"],
            days.cast("long").alias("DaysSinceStart"),
            (F.col("day_total") - v).alias("DateLOO_Sale"),
            (F.col("day_qty") - q).alias("DateLOO_Qty"),
            stats.leave_one_out(F.col("day_total"), F.col("day_count"), v).alias("DateLOO_Mean"),
            (prev * p).alias("PrevDayXPrice"),
            (prev * q).alias("PrevDayXQty"),
            (F.col("DailyRoll3") * q).alias("DailyRoll3XQty"),
            (F.col("DailyRoll3") * p).alias("DailyRoll3XPrice"),
            (F.col("DailyEWM3") * q).alias("DailyEWM3XQty"),
            safe_div(v, F.col("day_total") + 1).alias("SaleVsDateTotal"),
            dow_avg.alias("DOW_AvgDailyTotal"),
            safe_div(prev, dow_avg + 1).alias("SaleVsDOWTotal"),
        )

    def with_short_name(self, df: DataFrame) -> DataFrame:
        """F101-F106; whole columns 0.0 when the sheet has no Short Name."""
        c = self.cols
        q, v = F.col(c.qty), F.col(V)
        if self.N is None:
            f = df.select("*", *[F.lit(0.0).alias(n) for n in
                                 ("SN_AvgSale", "SN_SumSale", "SN_AvgPrice", "SN_AvgQty")])
        else:
            f = join_checked(df, self.N.drop("_SN_rows"), c.short_name)
        qsn = q * F.coalesce(F.col("SN_AvgPrice"), F.lit(0.0))
        return f.select("*", qsn.alias("QtyXSNAvgPrice"), (v - qsn).alias("ResidFromSN"))

    def with_ranks(self, df: DataFrame) -> DataFrame:
        """F107-F110: average-tie percent ranks (MatAvg_rank comes with M)."""
        c = self.cols
        return self._attached(df, [(self.rank_table(out, col), col, out) for col, out in (
            (c.qty, "SalQty_rank"), ("PricePerUnit", "Price_rank"), ("QtyXPrice", "QtyXPrice_rank"))])

    def with_codes(self, df: DataFrame) -> DataFrame:
        """F111-F116: label codes of the six text columns; a missing text has a
        code of its own, not that of the first class."""
        c = self.cols
        f = with_scalars(df, self.missing_codes())
        f = self._attached(f, [(self.code_table(name, col), col, name) for name, role in self.CODES
                               if (col := self._col(role)) and name not in f.columns])
        for name, role in self.CODES:
            if not self._col(role):
                f = f.withColumn(name, F.lit(None).cast("long"))
            else:
                f = f.withColumn(name, F.coalesce(name, f"_missing_{name}")).drop(f"_missing_{name}")
        return f

    def with_weather(self, df: DataFrame) -> DataFrame:
        """F117-F130: weather scalars on every row, traffic and delay indexes."""
        c = self.cols
        f = with_scalars(df, self.weather_row)
        q, p = F.col(c.qty), F.col("PricePerUnit")
        f = f.withColumn("TrafficIndex", cal.traffic_index("DayOfWeek", "w_is_rainy"))
        traffic = F.col("TrafficIndex")
        return f.select(
            "*",
            (F.col("w_temperature") * q).alias("TempXQty"),
            (F.col("w_temperature") * p).alias("TempXPrice"),
            (F.col("w_humidity") * q).alias("HumidXQty"),
            (F.col("w_rain_1h") * q).alias("RainXQty"),
            cal.delay_index("DayOfWeek", "w_is_rainy").alias("DeliveryDelayIndex"),
            (traffic * q).alias("TrafficXQty"),
            (traffic * p).alias("TrafficXPrice"),
        )

    def joined_lines(self, base: DataFrame) -> DataFrame:
        """The lines with what may come by shuffle joins: ranks, codes and their
        material's statistics. What is computed from these columns is not among them."""
        f = self._material_joined(self.with_codes(self.with_ranks(base)), self.M)
        computed = set(base.columns) - set(self.lines.columns)
        # a material's lines side by side: its statistics are then written about once
        return f.select(*[f"`{x}`" for x in f.columns if x not in computed]).sortWithinPartitions(self.cols.material)

    @cached_property
    def fact(self) -> DataFrame:
        """:meth:`joined_lines` of all lines, written once; where they are shuffled to their
        material's statistics, the lines of some materials at a time."""
        if not self.staged or estimated_bytes(self.M) <= joins.BROADCAST_MAX_BYTES:
            return self._stage(lambda: self.joined_lines(self.base), "features")
        at = F.pmod(F.xxhash64(self.cols.material), F.lit(FACT_ROUNDS))   # a missing material has a hash too
        first, *more = [self.joined_lines(self.base.where(at == n)) for n in range(FACT_ROUNDS)]
        return stage(first, "features", more=tuple(more))

    @cached_property
    def features(self) -> DataFrame:
        """The feature table (the model's input), computed from the narrow staged
        ``fact`` and small tables as it is read: some 140 doubles a line are not written."""
        return self.features_of(self.fact)

    @cached_property
    def last_features(self) -> DataFrame:
        """The features of each material's last line."""
        return self.features_of(self._stage(lambda: self.joined_lines(self.last_lines), "last-features"))

    @cached_property
    def last_line_features(self) -> DataFrame:
        """The features of the last line of the whole table."""
        last = self._stage(lambda: last_rows(self.lines, None, self.cols.order), "last-line")
        return self.features_of(self.joined_lines(self.row_features(last)))

    def features_of(self, joined: DataFrame) -> DataFrame:
        """:meth:`joined_lines` with every feature column (and the identifying columns)."""
        f = self.material_features(self.with_globals(self.row_features(joined)))
        f = self.with_groups(f)
        f = self.with_recon(f)
        f = self.with_daily(f)
        f = self.with_short_name(f)
        f = self.with_weather(f)
        return f

    @property
    def feature_names(self) -> list[str]:
        """The model's features: the original's list without what its sheets
        lack (P21: a text column that is not there is no feature)."""
        absent = {"Short Name": self.cols.short_name, "Material name": self.cols.material_name}
        return [n for n in FEATURES if absent.get(n, n)]
