"""Oracle SQL (DuckDB) for the named queries.

Each statement reads the pre-registered views (lineitem, orders, part,
supplier, nation, region, events) and recomputes the query from scratch with
plain SQL: windows over the whole table, medians, ``rank`` - the direct forms
the Spark plans avoid at scale. Outputs use the same names, types and rounding
(nine significant digits) as the Spark side. Nothing is imported from the
engine: tables and names are written out here.
"""

from __future__ import annotations

import json
import os

# ---- fixed values, written out for the oracle on its own -------------------
# Festive windows (month, first day, last day); traffic and delay indexes by
# day of week from Monday, their defaults and the rise when it rains; the
# features in matrix order.
FESTIVE_WINDOWS = [(1, 13, 17), (4, 13, 15), (8, 25, 35), (10, 20, 31), (11, 1, 10), (12, 23, 31)]
TRAFFIC_BASE, TRAFFIC_DEFAULT, TRAFFIC_RAIN = [0.78, 0.75, 0.58, 0.55, 0.70, 0.88, 0.85], 0.60, 0.10
DELAY_BASE, DELAY_DEFAULT, DELAY_RAIN = [0.30, 0.25, 0.20, 0.20, 0.35, 0.50, 0.45], 0.25, 0.20
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
# ---------------------------------------------------------------------------

_FIX = os.path.join(os.path.dirname(__file__), "..", "fixtures", "weather_payloads.jsonl")


def R(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    scale = f"pow(10.0::DOUBLE, 8 - floor(log10(abs({v}))))"
    return f"(CASE WHEN {v} = 0 THEN CAST(0.0 AS DOUBLE) WHEN {v} IS NOT NULL THEN round({v} * {scale}) / {scale} END)"


def MONEY(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR)"


def DBL(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _season_code(m: str) -> str:
    return (f"(CASE WHEN {m} BETWEEN 3 AND 5 THEN 1 WHEN {m} BETWEEN 6 AND 9 THEN 2 "
            f"WHEN {m} BETWEEN 10 AND 11 THEN 3 ELSE 0 END)")


def _season_name(m: str) -> str:
    return (f"(CASE WHEN {m} BETWEEN 3 AND 5 THEN 'Summer' WHEN {m} BETWEEN 6 AND 9 THEN 'SouthWest_Monsoon' "
            f"WHEN {m} BETWEEN 10 AND 11 THEN 'NorthEast_Monsoon' ELSE 'Winter' END)")


def _festive(m: str, d: str) -> str:
    parts = [f"({m} = {mm} AND {d} BETWEEN {d1} AND {min(d2, 31)})" for mm, d1, d2 in FESTIVE_WINDOWS]
    return "CAST((" + " OR ".join(parts) + ") AS INTEGER)"


def _dow_map(dow: str, table, default) -> str:
    whens = " ".join(f"WHEN {i} THEN {DBL(v)}" for i, v in enumerate(table))
    return f"(CASE {dow} {whens} ELSE {DBL(default)} END)"


def _traffic(dow: str, rainy: str) -> str:
    return (f"least({_dow_map(dow, TRAFFIC_BASE, TRAFFIC_DEFAULT)} + "
            f"(CASE WHEN {rainy} = 1 THEN {DBL(TRAFFIC_RAIN)} ELSE {DBL(0.0)} END), {DBL(1.0)})")


def _delay(dow: str, rainy: str) -> str:
    return (f"least({_dow_map(dow, DELAY_BASE, DELAY_DEFAULT)} + "
            f"(CASE WHEN {rainy} = 1 THEN {DBL(DELAY_RAIN)} ELSE {DBL(0.0)} END), {DBL(1.0)})")


def _ln1p(x: str) -> str:
    return f"(CASE WHEN {x} > -1 THEN ln(1 + {x}) END)"


def _cyc(x: str, period: int, fn: str) -> str:
    return f"{fn}({DBL(2 * 3.141592653589793)} * {x} / {DBL(float(period))})"


def _weather_values() -> str:
    rows = []
    with open(os.path.abspath(_FIX)) as fh:
        for line in fh:
            if line.strip():
                r = json.loads(line)
                pay = r["payload"].replace("'", "''")
                rows.append(f"('{r['city']}', {int(r['status'])}, '{pay}')")
    return ", ".join(rows)


def _beta(span: int) -> str:
    return DBL(1.0 - 2.0 / (span + 1.0))


def prelude() -> str:
    """Shared CTEs: adapter, joins, fills, stat tables, daily series, features."""
    P = "sal_qty"
    return f"""
sales AS (
  SELECT o.o_orderdate AS invoice_date, trim(CAST(l.l_partkey AS VARCHAR)) AS material_no,
         CAST(l.l_quantity AS DOUBLE) AS sal_qty, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS sale_value,
         trim(p.p_type) AS category, trim(p.p_brand) AS sku, trim(p.p_name) AS short_name,
         trim(p.p_name || '#' || CAST(p.p_partkey AS VARCHAR)) AS material_name,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
         l.l_discount, l.l_tax, l.l_shipdate
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
sku_buy AS (
  SELECT trim(CAST(p.p_partkey AS VARCHAR)) AS sap_code, trim(s.s_name) AS vendor, trim(r.r_name) AS type,
         trim(p.p_name) AS description, trim(p.p_type) AS category_label, p.p_partkey AS sheet_row
  FROM part p
  JOIN (SELECT l_partkey, min(l_suppkey) AS supp FROM lineitem GROUP BY l_partkey) ms ON p.p_partkey = ms.l_partkey
  JOIN supplier s ON ms.supp = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
masters AS (
  SELECT trim(CAST(p.p_partkey AS VARCHAR)) AS sap_code, trim(s.s_name) AS vendor, trim(p.p_name) AS description,
         trim(p.p_type) AS category_label, -l.supp AS sheet_row
  FROM (SELECT DISTINCT l_partkey, l_suppkey AS supp FROM lineitem) l JOIN part p ON p.p_partkey = l.l_partkey
  JOIN supplier s ON l.supp = s.s_suppkey),
indent_c AS (
  SELECT trim(CAST(p_partkey AS VARCHAR)) AS sap_code,
         coalesce(TRY_CAST(trim(CASE WHEN p_size > 40 THEN '-' ELSE ' ' || CAST(p_size * 10 AS VARCHAR) || ' ' END) AS DOUBLE), 0.0) AS soh,
         coalesce(TRY_CAST(CAST(p_size // 4 AS VARCHAR) AS DOUBLE), 0.0) AS indent
  FROM part),
crt_c AS (
  SELECT trim(CAST(p_partkey AS VARCHAR)) AS material, CAST(p_size AS DOUBLE) AS crt_size,
         CAST(p_size // 10 + 1 AS DOUBLE) AS no_crts
  FROM part),
joined AS (
  SELECT s.*, k.vendor, k.type, k.sku_hit, i.soh, i.indent, c.crt_size, c.no_crts
  FROM sales s
  LEFT JOIN (SELECT sap_code, vendor, type, 1 AS sku_hit FROM sku_buy) k ON s.material_no = k.sap_code
  LEFT JOIN indent_c i ON s.material_no = i.sap_code
  LEFT JOIN crt_c c ON s.material_no = c.material),
med_soh AS (SELECT coalesce(median(soh), 0.0) AS median_soh FROM joined),
filled AS (
  SELECT j.* EXCLUDE (vendor, type, soh, indent, crt_size, no_crts),
         CASE WHEN sku_hit IS NULL THEN 'UNKNOWN' ELSE vendor END AS vendor,
         CASE WHEN sku_hit IS NULL THEN 'UNKNOWN_VENDOR' ELSE type END AS type,
         coalesce(soh, m.median_soh) AS soh, coalesce(indent, 0.0) AS indent,
         coalesce(crt_size, 1.0) AS crt_size, coalesce(no_crts, 1.0) AS no_crts
  FROM joined j CROSS JOIN med_soh m),
base0 AS (
  SELECT *, CAST(sale_value AS DOUBLE) AS v,
         CAST(sale_value AS DOUBLE) / coalesce(nullif({P}, 0.0), 1.0) AS ppu,
         CAST(isodow(invoice_date) - 1 AS INTEGER) AS dow, CAST(month(invoice_date) AS INTEGER) AS mon,
         CAST(day(invoice_date) AS INTEGER) AS dom
  FROM filled),
base AS (
  SELECT *, {P} * ppu AS qp, {_season_code('mon')} AS season_code, {_festive('mon', 'dom')} AS is_festive
  FROM base0),
M AS (
  SELECT material_no,
         CAST(sum(sale_value) AS DOUBLE) / count(sale_value) AS Mat_AvgSale,
         median(v) AS Mat_MedSale, CAST(max(sale_value) AS DOUBLE) AS Mat_MaxSale,
         CAST(min(sale_value) AS DOUBLE) AS Mat_MinSale, coalesce(stddev_samp(v), 0.0) AS Mat_StdSale,
         coalesce(CAST(sum(sale_value) AS DOUBLE), 0.0) AS Mat_SumSale, count(sale_value) AS Mat_Count,
         avg({P}) AS Mat_AvgQty, avg(ppu) AS Mat_AvgPrice, median(ppu) AS Mat_MedPrice
  FROM base WHERE material_no IS NOT NULL GROUP BY material_no),
MD AS (SELECT material_no, dow, CAST(sum(sale_value) AS DOUBLE) AS md_sum, count(sale_value) AS md_cnt
       FROM base WHERE material_no IS NOT NULL GROUP BY material_no, dow),
MS AS (SELECT material_no, season_code, CAST(sum(sale_value) AS DOUBLE) AS ms_sum, count(sale_value) AS ms_cnt
       FROM base WHERE material_no IS NOT NULL GROUP BY material_no, season_code),
G AS (SELECT CAST(sum(sale_value) AS DOUBLE) / count(sale_value) AS global_mean, min(invoice_date) AS min_date,
             count(*) AS row_count, (SELECT max(Mat_Count) FROM M) AS max_mat_count FROM base),
{_group_cte('K', 'sku', 'SKU')},
{_group_cte('C', 'category', 'Category', extra=", sum(ppu * sal_qty) / nullif(coalesce(sum(sal_qty), 0.0) + 1, 0) AS Cat_WAvgPrice")},
{_group_cte('V', 'vendor', 'VENDOR')},
N AS (SELECT short_name, CAST(sum(sale_value) AS DOUBLE) / count(sale_value) AS SN_AvgSale,
             coalesce(CAST(sum(sale_value) AS DOUBLE), 0.0) AS SN_SumSale, avg(ppu) AS SN_AvgPrice,
             avg({P}) AS SN_AvgQty
      FROM base WHERE short_name IS NOT NULL GROUP BY short_name),
D0 AS (SELECT invoice_date, CAST(sum(sale_value) AS DOUBLE) AS day_total, coalesce(sum({P}), 0.0) AS day_qty,
              count(sale_value) AS day_count FROM base GROUP BY invoice_date),
DI AS (SELECT *, row_number() OVER (ORDER BY invoice_date) - 1 AS day_idx FROM D0),
DP AS (SELECT d.*, coalesce(p.day_total, 0.0) AS PrevDayTotalSale,
              coalesce(CAST(p.day_qty AS DOUBLE), 0.0) AS PrevDayTotalQty,
              coalesce(CAST(p.day_count AS DOUBLE), 0.0) AS PrevDayRowCount
       FROM DI d LEFT JOIN D0 p ON p.invoice_date = d.invoice_date - INTERVAL 1 DAY),
DR AS (SELECT *, {_rolls('day_idx', '')} FROM DP),
DE AS (SELECT d.day_idx, {_ewms('d', 'e')}
       FROM DI d JOIN DI e ON e.day_idx < d.day_idx GROUP BY d.day_idx),
DOWA AS (SELECT CAST(isodow(invoice_date) - 1 AS INTEGER) AS dow, avg(day_total) AS DOW_AvgDailyTotal
         FROM D0 GROUP BY 1),
D AS (SELECT r.*, coalesce(e.DailyEWM3, 0.0) AS DailyEWM3, coalesce(e.DailyEWM5, 0.0) AS DailyEWM5,
             r.PrevDayTotalSale - r.DailyRoll3 AS DailyMomentum,
             r.DailyRoll3 / nullif(r.DailyRoll7 + 1, 0) AS DailyTrend3v7,
             w.DOW_AvgDailyTotal AS dow_avg_total
      FROM DR r LEFT JOIN DE e ON r.day_idx = e.day_idx
      LEFT JOIN DOWA w ON w.dow = CAST(isodow(r.invoice_date) - 1 AS INTEGER)),
weather_raw(city, status, payload) AS (VALUES {_weather_values()}),
weather_fields AS (
  SELECT city, status,
         TRY_CAST(json_extract(payload, '$.main.temp') AS DOUBLE) AS t,
         TRY_CAST(json_extract(payload, '$.main.humidity') AS DOUBLE) AS h,
         TRY_CAST(json_extract(payload, '$.wind.speed') AS DOUBLE) AS w,
         coalesce(TRY_CAST(json_extract(payload, '$.rain."1h"') AS DOUBLE), 0.0) AS r,
         TRY_CAST(json_extract(payload, '$.weather[0].id') AS INTEGER) AS wid
  FROM weather_raw),
weather_parsed AS (
  SELECT city,
         CASE WHEN ok THEN t END AS temp, CASE WHEN ok THEN h END AS humidity,
         CASE WHEN ok THEN w END AS wind, CASE WHEN ok THEN r END AS rain_1h,
         CASE WHEN ok THEN CAST(wid < 700 AS INTEGER) END AS is_rainy
  FROM (SELECT *, (status = 200 AND t IS NOT NULL AND h IS NOT NULL AND w IS NOT NULL AND wid IS NOT NULL) AS ok
        FROM weather_fields)),
weather0 AS (
  SELECT coalesce(avg(temp), 30.0) AS temperature, coalesce(avg(humidity), 68.0) AS humidity,
         coalesce(avg(wind), 5.0) AS wind_speed, coalesce(avg(rain_1h), 0.0) AS rain_1h,
         CAST(coalesce(max(is_rainy), 0) AS INTEGER) AS is_rainy
  FROM weather_parsed),
W AS (SELECT *, temperature + {DBL(0.33)} * (humidity / {DBL(100.0)} * {DBL(6.105)}
             * exp(({DBL(17.27)} * temperature) / ({DBL(237.7)} + temperature))) - {DBL(4.0)} AS heat_index
      FROM weather0),
fm0 AS (
  SELECT b.*, g.global_mean, g.min_date, g.max_mat_count,
         m.Mat_AvgSale, m.Mat_MedSale, m.Mat_MaxSale, m.Mat_MinSale, m.Mat_StdSale, m.Mat_SumSale,
         m.Mat_Count, m.Mat_AvgQty, m.Mat_AvgPrice, m.Mat_MedPrice,
         md.md_sum, md.md_cnt, ms.ms_sum, ms.ms_cnt
  FROM base b CROSS JOIN G g
  LEFT JOIN M m ON b.material_no = m.material_no
  LEFT JOIN MD md ON b.material_no = md.material_no AND b.dow = md.dow
  LEFT JOIN MS ms ON b.material_no = ms.material_no AND b.season_code = ms.season_code),
fm1 AS (
  SELECT *,
    Mat_MaxSale - Mat_MinSale AS Mat_SaleRange,
    (v - Mat_MinSale) / (Mat_MaxSale - Mat_MinSale + 1) AS Mat_SaleNorm,
    Mat_Count / max_mat_count AS Mat_FreqWeight,
    {P} * Mat_AvgPrice AS QtyXMatAvgPrice, {P} * Mat_MedPrice AS QtyXMatMedPrice,
    v - {P} * Mat_AvgPrice AS ResidFromMat,
    ppu / nullif(Mat_AvgPrice + 1, 0) AS PriceVsMatAvg, {P} / nullif(Mat_AvgQty + 1, 0) AS QtyVsMatAvg,
    {_ln1p(P + ' * Mat_AvgPrice')} AS Log_QtyXMatAvg,
    (v - Mat_AvgSale) / (Mat_StdSale + 1e-9) AS Sale_MatZscore,
    (Mat_SumSale - v) / (Mat_Count - 1 + 1e-9) AS TE_LOO_Mat,
    (Mat_Count * Mat_AvgSale + {DBL(5.0)} * global_mean) / (Mat_Count + {DBL(5.0)}) AS TE_Smooth_Mat,
    ppu - Mat_AvgPrice AS ExactPriceDev, {P} * (ppu - Mat_AvgPrice) AS QtyXPriceDev,
    coalesce(md_sum / nullif(md_cnt, 0), Mat_AvgSale) AS Mat_DOW_AvgSale,
    (md_sum - v + {DBL(3.0)} * global_mean) / (md_cnt - 1 + {DBL(3.0)} + 1e-9) AS TE_Smooth_MatDOW,
    coalesce(ms_sum / nullif(ms_cnt, 0), Mat_AvgSale) AS Mat_SeasonAvgSale
  FROM fm0),
fm AS (
  SELECT *,
    ({P} * TE_Smooth_Mat) / nullif(Mat_AvgQty + 1, 0) AS QtyXTESmooth,
    {P} * (Mat_DOW_AvgSale / nullif(Mat_AvgQty + 1, 0)) AS QtyXMatDOWAvg,
    ({P} * TE_Smooth_MatDOW) / nullif(Mat_AvgQty + 1, 0) AS QtyXTE_MatDOW,
    coalesce(CAST(Mat_SeasonAvgSale > Mat_AvgSale AS INTEGER), 0) AS IsSeasonalProduct,
    Mat_SeasonAvgSale / (Mat_AvgSale + 1e-9) AS SeasonalLift,
    coalesce(CAST(Mat_SeasonAvgSale > Mat_AvgSale AS INTEGER), 0) * {P} AS SeasonalXQty,
    (Mat_SeasonAvgSale / (Mat_AvgSale + 1e-9)) * {P} AS SeasonalLiftXQty,
    is_festive * {P} AS FestiveXQty
  FROM fm1),
fg0 AS (
  SELECT f.*, k.SKU_AvgSale, k.SKU_MedSale, k.SKU_MaxSale, k.SKU_SumSale, k.SKU_AvgQty, k.SKU_AvgPrice,
         k.SKU_Count, c.Category_AvgSale, c.Category_MedSale, c.Category_MaxSale, c.Category_SumSale,
         c.Category_AvgQty, c.Category_AvgPrice, c.Category_Count, c.Cat_WAvgPrice,
         vv.VENDOR_AvgSale, vv.VENDOR_SumSale, vv.VENDOR_AvgPrice
  FROM fm f LEFT JOIN K k ON f.sku = k.sku LEFT JOIN C c ON f.category = c.category
  LEFT JOIN V vv ON f.vendor = vv.vendor),
fg AS (
  SELECT *, Category_AvgPrice AS Cat_AvgPrice,
    {P} * SKU_AvgPrice AS QtyXSKUAvgPrice, {P} * Category_AvgPrice AS QtyXCatAvgPrice,
    {P} * Cat_WAvgPrice AS QtyXCatWAvgPrice,
    v - {P} * SKU_AvgPrice AS ResidFromSKU, v - {P} * Category_AvgPrice AS ResidFromCat,
    v / nullif(SKU_AvgSale + 1, 0) AS SaleVsSKURatio, v / nullif(Category_AvgSale + 1, 0) AS SaleVsCatRatio,
    ppu - SKU_AvgPrice AS PriceDevSKU,
    (SKU_SumSale - v) / (SKU_Count - 1 + 1e-9) AS TE_LOO_SKU
  FROM fg0),
fr0 AS (
  SELECT *,
    (coalesce(QtyXMatAvgPrice, 0) + coalesce(QtyXMatMedPrice, 0) + coalesce(QtyXSKUAvgPrice, 0)
     + coalesce(QtyXCatAvgPrice, 0) + coalesce(QtyXCatWAvgPrice, 0) + coalesce(QtyXTESmooth, 0))
    / nullif(CAST(QtyXMatAvgPrice IS NOT NULL AS INTEGER) + CAST(QtyXMatMedPrice IS NOT NULL AS INTEGER)
     + CAST(QtyXSKUAvgPrice IS NOT NULL AS INTEGER) + CAST(QtyXCatAvgPrice IS NOT NULL AS INTEGER)
     + CAST(QtyXCatWAvgPrice IS NOT NULL AS INTEGER) + CAST(QtyXTESmooth IS NOT NULL AS INTEGER), 0)
    AS ReconEnsemble
  FROM fg),
fr AS (SELECT *, v - ReconEnsemble AS ResidFromRecon, {_ln1p('ReconEnsemble')} AS Log_ReconEns FROM fr0),
fd0 AS (
  SELECT f.*, d.day_total, d.day_qty, d.day_count, d.PrevDayTotalSale, d.PrevDayTotalQty, d.PrevDayRowCount,
         d.DailyRoll2, d.DailyRoll3, d.DailyRoll5, d.DailyRoll7, d.DailyEWM3, d.DailyEWM5,
         d.DailyMomentum, d.DailyTrend3v7, d.dow_avg_total
  FROM fr f LEFT JOIN D d ON f.invoice_date = d.invoice_date),
fd AS (
  SELECT *,
    CAST(floor((epoch_us(invoice_date) - epoch_us(min_date)) / 86400000000) AS BIGINT) AS DaysSinceStart,
    day_total - v AS DateLOO_Sale, day_qty - {P} AS DateLOO_Qty,
    (day_total - v) / (day_count - 1 + 1e-9) AS DateLOO_Mean,
    PrevDayTotalSale * ppu AS PrevDayXPrice, PrevDayTotalSale * {P} AS PrevDayXQty,
    DailyRoll3 * {P} AS DailyRoll3XQty, DailyRoll3 * ppu AS DailyRoll3XPrice, DailyEWM3 * {P} AS DailyEWM3XQty,
    v / nullif(day_total + 1, 0) AS SaleVsDateTotal,
    coalesce(dow_avg_total, global_mean) AS DOW_AvgDailyTotal,
    PrevDayTotalSale / nullif(coalesce(dow_avg_total, global_mean) + 1, 0) AS SaleVsDOWTotal
  FROM fd0),
fs AS (
  SELECT f.*, n.SN_AvgSale, n.SN_SumSale, n.SN_AvgPrice, n.SN_AvgQty,
         {P} * coalesce(n.SN_AvgPrice, 0.0) AS QtyXSNAvgPrice, v - {P} * coalesce(n.SN_AvgPrice, 0.0) AS ResidFromSN
  FROM fd f LEFT JOIN N n ON f.short_name = n.short_name),
fk AS (
  SELECT *, {_rank(P)} AS SalQty_rank, {_rank('ppu')} AS Price_rank, {_rank('Mat_AvgSale')} AS MatAvg_rank,
         {_rank('qp')} AS QtyXPrice_rank
  FROM fs),
fc AS (
  SELECT f.*, c1.code AS Category_code, c2.code AS SKU_code, c3.code AS VENDOR_code, c4.code AS TYPE_code,
         c5.code AS ShortName_code, c6.code AS MaterialName_code
  FROM fk f
  LEFT JOIN ({_codes('category')}) c1 ON f.category = c1.x
  LEFT JOIN ({_codes('sku')}) c2 ON f.sku = c2.x
  LEFT JOIN ({_codes('vendor')}) c3 ON f.vendor = c3.x
  LEFT JOIN ({_codes('type')}) c4 ON f.type = c4.x
  LEFT JOIN ({_codes('short_name')}) c5 ON f.short_name = c5.x
  LEFT JOIN ({_codes('material_name')}) c6 ON f.material_name = c6.x),
feat AS (
  SELECT f.*, w.temperature AS Temperature, w.humidity AS Humidity, w.wind_speed AS WindSpeed,
         w.rain_1h AS Rain_1h, w.is_rainy AS IsRainy, w.heat_index AS HeatIndex,
         w.temperature * {P} AS TempXQty, w.temperature * ppu AS TempXPrice,
         w.humidity * {P} AS HumidXQty, w.rain_1h * {P} AS RainXQty,
         {_traffic('dow', 'w.is_rainy')} AS TrafficIndex, {_delay('dow', 'w.is_rainy')} AS DeliveryDelayIndex,
         {_traffic('dow', 'w.is_rainy')} * {P} AS TrafficXQty, {_traffic('dow', 'w.is_rainy')} * ppu AS TrafficXPrice
  FROM fc f CROSS JOIN W w)
"""


def _group_cte(name, key, prefix, extra=""):
    return f"""{name} AS (
  SELECT {key}, CAST(sum(sale_value) AS DOUBLE) / count(sale_value) AS {prefix}_AvgSale,
         median(v) AS {prefix}_MedSale, CAST(max(sale_value) AS DOUBLE) AS {prefix}_MaxSale,
         coalesce(CAST(sum(sale_value) AS DOUBLE), 0.0) AS {prefix}_SumSale, avg(sal_qty) AS {prefix}_AvgQty,
         avg(ppu) AS {prefix}_AvgPrice, count(sale_value) AS {prefix}_Count {extra}
  FROM base WHERE {key} IS NOT NULL GROUP BY {key})"""


def _rolls(order: str, part: str) -> str:
    pb = f"PARTITION BY {part} " if part else ""
    return ", ".join(
        f"coalesce(avg(day_total) OVER ({pb}ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0.0)"
        f" AS DailyRoll{n}" for n in (2, 3, 5, 7))


def _ewms(d: str, e: str) -> str:
    out = []
    for s in (3, 5):
        wgt = f"power({_beta(s)}, {d}.day_idx - {e}.day_idx - 1)"
        out.append(f"sum({wgt} * {e}.day_total) / sum({wgt}) AS DailyEWM{s}")
    return ", ".join(out)


def _rank(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL ELSE (rank() OVER (ORDER BY {x}) "
            f"+ (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER () END)")


def _codes(col: str) -> str:
    return (f"SELECT x, dense_rank() OVER (ORDER BY x) - 1 AS code "
            f"FROM (SELECT DISTINCT {col} AS x FROM base WHERE {col} IS NOT NULL)")


IDS = ("CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
       "material_no, CAST(l_suppkey AS BIGINT) AS l_suppkey")


def q(body: str) -> str:
    return "WITH " + prelude() + "\n" + body


def _same(cols, src=None):
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


def _ids_sql(dbl=(), lng=(), other=()):
    parts = [IDS]
    parts += [f"{R(c)} AS {a}" for c, a in dbl]
    parts += [f"CAST({c} AS BIGINT) AS {a}" for c, a in lng]
    parts += [f"{c} AS {a}" for c, a in other]
    return ", ".join(parts)


def _pairs(names):
    return [(n, n) for n in names]


GROUP_STATS = ("AvgSale", "MedSale", "MaxSale", "SumSale", "AvgQty", "AvgPrice", "Count")


def _stat(c):
    x = f"CAST({c} AS BIGINT)" if c.endswith("_Count") else MONEY(c) if c.endswith("_SumSale") else R(c)
    return f"{x} AS {c}"


def _group_select(tbl, key, prefix):
    cols = ", ".join(_stat(f"{prefix}_{s}") for s in GROUP_STATS)
    return f"SELECT {key}, {cols} FROM {tbl}"


MAT_STATS = ["Mat_AvgSale", "Mat_MedSale", "Mat_MaxSale", "Mat_MinSale", "Mat_StdSale",
             "Mat_SumSale", "Mat_Count", "Mat_AvgQty", "Mat_AvgPrice", "Mat_MedPrice"]

OVERRIDES = ["Temperature", "Humidity", "WindSpeed", "Rain_1h", "IsRainy", "HeatIndex", "TempXQty",
             "TempXPrice", "HumidXQty", "RainXQty", "TrafficIndex", "DeliveryDelayIndex", "TrafficXQty",
             "TrafficXPrice", "Month", "SeasonCode", "Month_sin", "Month_cos", "IsFestive", "Stock_Demand"]

NEXT = "DATE '2025-03-22'"
ORDER = ("invoice_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
         "l_discount, l_tax, l_shipdate")
ORDER_DESC = ", ".join(c.strip() + " DESC" for c in ORDER.split(","))


def _feature_expr(name: str) -> str:
    m = {"SalQty": "sal_qty", "SOH": "soh", "Indent": "indent", "PricePerUnit": "ppu", "QtyXPrice": "qp",
         "Log_SalQty": _ln1p("sal_qty"), "Log_Price": _ln1p("ppu"), "Log_QtyXPrice": _ln1p("qp"),
         "Sqrt_QtyXPrice": "sqrt(abs(qp))", "StockPressure": "sal_qty / nullif(soh + 1, 0)",
         "StockCoverage": "soh / nullif(sal_qty + 1, 0)", "IndentRatio": "indent / nullif(soh + 1, 0)",
         "Stock_Demand": "soh - sal_qty", "DayOfWeek": "dow", "DayOfMonth": "dom",
         "IsWeekend": "CAST(dow IN (5, 6) AS INTEGER)", "DOW_sin": _cyc("dow", 7, "sin"),
         "DOW_cos": _cyc("dow", 7, "cos"), "Month": "mon", "SeasonCode": "season_code",
         "Month_sin": _cyc("mon", 12, "sin"), "Month_cos": _cyc("mon", 12, "cos"), "IsFestive": "is_festive",
         "Category": "Category_code", "SKU": "SKU_code", "VENDOR": "VENDOR_code", "TYPE": "TYPE_code",
         "Short Name": "ShortName_code", "Material name": "MaterialName_code"}
    return m.get(name, name)


def _sanitize(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE {x} END)"


def _product_frame() -> str:
    """CTEs: last line per material and the product rows on the stand-in score."""
    return f""",
last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material_no ORDER BY {ORDER_DESC}) AS rn
                 FROM feat WHERE material_no IS NOT NULL) WHERE rn = 1),
meta AS (
  SELECT sap_code AS material_no, arg_min(category_label, sheet_row) AS category_label,
         arg_min(description, sheet_row) AS mat_description, arg_min(vendor, sheet_row) AS vendor_name
  FROM sku_buy GROUP BY sap_code),
ctx AS (
  SELECT {_season_name('month(' + NEXT + ')')} AS next_season,
         {_festive('month(' + NEXT + ')', 'day(' + NEXT + ')')} AS next_festive,
         {_traffic('(isodow(' + NEXT + ') - 1)', 'w.is_rainy')} AS next_traffic,
         {_delay('(isodow(' + NEXT + ') - 1)', 'w.is_rainy')} AS next_delay
  FROM W w),
score AS (
  SELECT m.material_no, (m.Mat_Count * m.Mat_AvgSale + {DBL(5.0)} * g.global_mean) / (m.Mat_Count + {DBL(5.0)}) AS score
  FROM M m CROSS JOIN G g),
products AS (
  SELECT l.material_no,
         CASE WHEN mt.material_no IS NOT NULL THEN mt.category_label || ' — ' || mt.mat_description ELSE l.material_no END AS display_name,
         CASE WHEN mt.material_no IS NOT NULL THEN mt.category_label ELSE 'Unknown' END AS category,
         CASE WHEN mt.material_no IS NOT NULL THEN mt.mat_description ELSE l.material_no END AS mat_description,
         CASE WHEN mt.material_no IS NOT NULL THEN mt.vendor_name ELSE 'Unknown' END AS vendor,
         {_r2('s.score')} AS predicted_sale,
         {_r2('greatest(CASE WHEN l.Mat_AvgPrice > 0 THEN s.score / l.Mat_AvgPrice ELSE 0.0 END, 0.0)')} AS predicted_qty,
         {_r2('l.Mat_AvgPrice')} AS avg_price, {_r2('l.v')} AS last_actual, {_r2('l.Mat_AvgSale')} AS avg_sale,
         c.next_season AS season, CAST(l.IsSeasonalProduct AS BIGINT) AS is_seasonal,
         {_r2('l.SeasonalLift')} AS seasonal_lift, {_r2('l.soh')} AS soh, {_r2('l.indent')} AS indent,
         CAST(c.next_festive AS BIGINT) AS is_festive_day, {_r2('c.next_traffic')} AS traffic_index,
         {_r2('c.next_delay')} AS delay_index
  FROM last l LEFT JOIN score s ON l.material_no = s.material_no
  LEFT JOIN meta mt ON l.material_no = mt.material_no CROSS JOIN ctx c)
"""


def _r2(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE) * 100.0) / 100.0)"


def oracle_sql() -> dict[str, str]:
    S = {}
    S["clean_indent"] = q(f"SELECT sap_code, {R('soh')} AS soh, {R('indent')} AS indent FROM indent_c")
    S["enrich_left_joins"] = q(f"SELECT {_ids_sql(_pairs(['soh', 'indent', 'crt_size', 'no_crts']), [('coalesce(sku_hit, 0)', 'sku_hit')], _pairs(['vendor', 'type']))} FROM joined")
    S["fill_defaults"] = q(f"SELECT {_ids_sql(_pairs(['soh', 'indent', 'crt_size', 'no_crts']), (), _pairs(['vendor', 'type']))} FROM filled")
    S["dedup_first"] = q(
        "SELECT sap_code AS material_no, arg_min(category_label, sheet_row) AS category_label, "
        "arg_min(description, sheet_row) AS mat_description, arg_min(vendor, sheet_row) AS vendor_name, "
        "arg_min(category_label, sheet_row) || ' — ' || arg_min(description, sheet_row) AS display_name "
        "FROM masters GROUP BY sap_code")
    S["master_multiplicity"] = q(
        "SELECT s.material_no, s.n_lines, coalesce(m.n, 0) AS n_master_rows, s.n_lines * greatest(coalesce(m.n, 0), 1) AS n_joined_lines "
        "FROM (SELECT material_no, count(*) AS n_lines FROM sales GROUP BY 1) s "
        "LEFT JOIN (SELECT sap_code, count(*) AS n FROM masters GROUP BY 1) m ON s.material_no = m.sap_code")
    S["price_qty_features"] = q(
        f"SELECT {_ids_sql([('sal_qty', 'SalQty'), ('ppu', 'PricePerUnit'), ('qp', 'QtyXPrice'), (_ln1p('sal_qty'), 'Log_SalQty'), (_ln1p('ppu'), 'Log_Price'), (_ln1p('qp'), 'Log_QtyXPrice'), ('sqrt(abs(qp))', 'Sqrt_QtyXPrice')])} FROM base")
    S["stock_features"] = q(
        f"SELECT {_ids_sql([('soh', 'SOH'), ('indent', 'Indent'), ('sal_qty / nullif(soh + 1, 0)', 'StockPressure'), ('soh / nullif(sal_qty + 1, 0)', 'StockCoverage'), ('indent / nullif(soh + 1, 0)', 'IndentRatio'), ('soh - sal_qty', 'Stock_Demand')])} FROM base")
    S["material_stats"] = q("SELECT material_no, " + ", ".join(
        _stat(c) for c in MAT_STATS) + " FROM M")
    S["sku_stats"] = q(_group_select("K", "sku", "SKU"))
    S["category_stats"] = q(_group_select("C", "category", "Category"))
    S["vendor_stats"] = "WITH " + prelude() + ",\n" + _group_cte("V7", "vendor", "VENDOR") + "\n" + \
        _group_select("V7", "vendor", "VENDOR")
    S["shortname_stats"] = q("SELECT short_name, " + ", ".join(_stat(c) for c in ("SN_AvgSale", "SN_SumSale", "SN_AvgPrice", "SN_AvgQty")) + " FROM N")
    S["global_stats"] = q(f"SELECT {R('global_mean')} AS global_mean, {R('median_soh')} AS median_soh, min_date, "
                          "CAST(max_mat_count AS BIGINT) AS max_mat_count, CAST(row_count AS BIGINT) AS row_count "
                          "FROM G CROSS JOIN med_soh")
    S["weighted_price"] = q(f"SELECT category, {R('Cat_WAvgPrice')} AS Cat_WAvgPrice FROM C")
    S["recon_ensemble"] = q(f"SELECT {_ids_sql(_pairs(['ReconEnsemble', 'ResidFromRecon', 'Log_ReconEns']))} FROM feat")
    S["loo_encoding"] = q(f"SELECT {_ids_sql(_pairs(['TE_LOO_Mat', 'TE_LOO_SKU', 'DateLOO_Sale', 'DateLOO_Qty', 'DateLOO_Mean']))} FROM feat")
    S["smooth_encoding"] = q(f"SELECT {_ids_sql(_pairs(['TE_Smooth_Mat', 'QtyXTESmooth', 'TE_Smooth_MatDOW', 'QtyXTE_MatDOW']))} FROM feat")
    S["mat_zscore"] = q(f"SELECT {_ids_sql(_pairs(['Sale_MatZscore']))} FROM feat")
    S["mat_minmax"] = q(f"SELECT {_ids_sql(_pairs(['Mat_SaleRange', 'Mat_SaleNorm', 'Mat_FreqWeight']))} FROM feat")
    S["share_of_day"] = q(f"SELECT {_ids_sql(_pairs(['SaleVsDateTotal']))} FROM feat")
    S["mat_dow_features"] = q(f"SELECT {_ids_sql(_pairs(['Mat_DOW_AvgSale', 'QtyXMatDOWAvg']))} FROM feat")
    S["dow_avg_total"] = q(f"SELECT CAST(dow AS BIGINT) AS DayOfWeek, {R('DOW_AvgDailyTotal')} AS DOW_AvgDailyTotal FROM DOWA")
    S["season_lift"] = q(f"SELECT {_ids_sql(_pairs(['Mat_SeasonAvgSale', 'SeasonalLift', 'SeasonalLiftXQty', 'SeasonalXQty']), [('IsSeasonalProduct', 'IsSeasonalProduct')])} FROM feat")
    days = "(SELECT DISTINCT b.invoice_date, g.min_date FROM base b CROSS JOIN G g)"
    dow = "(isodow(invoice_date) - 1)"
    mon = "month(invoice_date)"
    S["calendar_features"] = q(
        f"SELECT invoice_date, CAST({dow} AS BIGINT) AS DayOfWeek, CAST(day(invoice_date) AS BIGINT) AS DayOfMonth, "
        f"CAST({dow} IN (5, 6) AS BIGINT) AS IsWeekend, "
        f"CAST(floor((epoch_us(invoice_date) - epoch_us(min_date)) / 86400000000) AS BIGINT) AS DaysSinceStart, "
        f"{R(_cyc(dow, 7, 'sin'))} AS DOW_sin, {R(_cyc(dow, 7, 'cos'))} AS DOW_cos, CAST({mon} AS BIGINT) AS Month, "
        f"CAST({_season_code(mon)} AS BIGINT) AS SeasonCode, {_season_name(mon)} AS SeasonName, "
        f"{R(_cyc(mon, 12, 'sin'))} AS Month_sin, {R(_cyc(mon, 12, 'cos'))} AS Month_cos FROM {days}")
    S["festive_flag"] = q(f"SELECT invoice_date, CAST({_festive(mon, 'day(invoice_date)')} AS BIGINT) AS IsFestive FROM {days}")
    S["traffic_delay"] = q(f"SELECT invoice_date, {R(_traffic(dow, 'w.is_rainy'))} AS TrafficIndex, "
                           f"{R(_delay(dow, 'w.is_rainy'))} AS DeliveryDelayIndex FROM {days} CROSS JOIN W w")
    S["weather_features"] = q(f"SELECT {_ids_sql(_pairs(['Temperature', 'Humidity', 'WindSpeed', 'Rain_1h', 'HeatIndex', 'TempXQty', 'TempXPrice', 'HumidXQty', 'RainXQty', 'TrafficXQty', 'TrafficXPrice']), [('IsRainy', 'IsRainy')])} FROM feat")
    S["daily_totals"] = q(f"SELECT invoice_date, {MONEY('day_total')} AS day_total, {R('day_qty')} AS day_qty, "
                          "CAST(day_count AS BIGINT) AS day_count FROM D0")
    S["prev_day"] = q("SELECT invoice_date, " + _same(["PrevDayTotalSale", "PrevDayTotalQty", "PrevDayRowCount"]) + " FROM D")
    S["rolling_means"] = q("SELECT invoice_date, " + _same(["DailyRoll2", "DailyRoll3", "DailyRoll5", "DailyRoll7"]) + " FROM D")
    S["ewm_means"] = q("SELECT invoice_date, " + _same(["DailyEWM3", "DailyEWM5"]) + " FROM D")
    S["momentum_trend"] = q("SELECT invoice_date, " + _same(["DailyMomentum", "DailyTrend3v7"]) + " FROM D")
    ev = ("ev AS (SELECT event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, "
          "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS day_total FROM events GROUP BY 1, 2), "
          "evi AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS day_idx FROM ev)")
    S["events_rolling"] = (
        f"WITH {ev}, evr AS (SELECT *, {_rolls('day_idx', 'event_type')} FROM evi) "
        "SELECT event_type, day, " + ", ".join(f"{R(f'DailyRoll{n}')} AS roll{n}" for n in (2, 3, 5, 7)) + " FROM evr")
    ew = ", ".join(
        f"{R(f'coalesce(sum(power({_beta(s)}, d.day_idx - e.day_idx - 1) * e.day_total) / sum(power({_beta(s)}, d.day_idx - e.day_idx - 1)), 0.0)')} AS ewm{s}"
        for s in (3, 5))
    S["events_ewm"] = (
        f"WITH {ev} SELECT d.event_type, d.day, {ew} FROM evi d LEFT JOIN evi e "
        "ON e.event_type = d.event_type AND e.day_idx < d.day_idx GROUP BY d.event_type, d.day")
    S["pct_ranks"] = q(f"SELECT {_ids_sql(_pairs(['SalQty_rank', 'Price_rank', 'MatAvg_rank', 'QtyXPrice_rank']))} FROM feat")
    S["label_codes"] = q(f"SELECT {_ids_sql((), _pairs(['Category_code', 'SKU_code', 'VENDOR_code', 'TYPE_code', 'ShortName_code', 'MaterialName_code']))} FROM feat")
    split = (f", sp AS (SELECT *, CAST(row_number() OVER (ORDER BY {ORDER}) <= "
             f"floor(count(*) OVER () * {DBL(0.8)}) AS INTEGER) AS is_train FROM base)")
    S["time_split"] = "WITH " + prelude() + split + f"\nSELECT {_ids_sql((), [('is_train', 'is_train')])} FROM sp"
    S["split_bounds"] = "WITH " + prelude() + split + (
        "\nSELECT max(CASE WHEN is_train = 1 THEN invoice_date END) AS last_train_date, "
        "min(CASE WHEN is_train = 0 THEN invoice_date END) AS first_test_date, "
        "CAST(sum(is_train) AS BIGINT) AS n_train, CAST(sum(1 - is_train) AS BIGINT) AS n_test FROM sp")
    sel = ", ".join(f"{_sanitize(_feature_expr(n))} AS \"f{i}\", "
                    f"CAST(({_feature_expr(n)}) IS NULL OR isnan(CAST({_feature_expr(n)} AS DOUBLE)) "
                    f"OR isinf(CAST({_feature_expr(n)} AS DOUBLE)) AS DOUBLE) AS \"b{i}\""
                    for i, n in enumerate(FEATURES))
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(FEATURES))
    S["feature_matrix"] = "WITH " + prelude() + f""",
mx AS (SELECT {sel} FROM feat),
lg AS (UNPIVOT mx ON COLUMNS(*) INTO NAME fname VALUE x),
nm(pos, feature) AS (VALUES {names}),
vals AS (SELECT nm.pos, nm.feature, lg.x FROM lg JOIN nm ON lg.fname = 'f' || CAST(nm.pos AS VARCHAR)),
bads AS (SELECT nm.pos, CAST(sum(lg.x) AS BIGINT) AS n_nonfinite FROM lg JOIN nm ON lg.fname = 'b' || CAST(nm.pos AS VARCHAR)
         GROUP BY nm.pos)
SELECT CAST(v.pos AS BIGINT) AS pos, v.feature, count(*) AS n_rows, any_value(b.n_nonfinite) AS n_nonfinite,
       CAST(sum(CAST(v.x = 0 AS BIGINT)) AS BIGINT) AS n_zero,
       {R('min(v.x)')} AS min_value, {R('max(v.x)')} AS max_value
FROM vals v JOIN bads b ON v.pos = b.pos GROUP BY v.pos, v.feature"""
    S["last_row_per_material"] = q(
        f"SELECT material_no, CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
        f"CAST(l_suppkey AS BIGINT) AS l_suppkey, invoice_date, {R('v')} AS last_actual, {R('sal_qty')} AS SalQty, "
        f"{R('ppu')} AS PricePerUnit FROM (SELECT *, row_number() OVER (PARTITION BY material_no ORDER BY {ORDER_DESC}) AS rn "
        "FROM base WHERE material_no IS NOT NULL) WHERE rn = 1")
    nd_mon = f"month({NEXT})"
    nd_dow = f"(isodow({NEXT}) - 1)"
    over = {
        "TempXQty": "Temperature * sal_qty", "TempXPrice": "Temperature * ppu",
        "HumidXQty": "Humidity * sal_qty", "RainXQty": "Rain_1h * sal_qty",
        "TrafficIndex": _traffic(nd_dow, "IsRainy"), "DeliveryDelayIndex": _delay(nd_dow, "IsRainy"),
        "TrafficXQty": _traffic(nd_dow, "IsRainy") + " * sal_qty", "TrafficXPrice": _traffic(nd_dow, "IsRainy") + " * ppu",
        "Month": nd_mon, "SeasonCode": _season_code(nd_mon), "Month_sin": _cyc(nd_mon, 12, "sin"),
        "Month_cos": _cyc(nd_mon, 12, "cos"), "IsFestive": _festive(nd_mon, f"day({NEXT})"),
        "Stock_Demand": "soh - sal_qty",
    }
    S["next_day_rows"] = q(
        "SELECT material_no, " + ", ".join(f"{R(over.get(n, n))} AS {n}" for n in OVERRIDES) +
        f", {R('DailyRoll3')} AS DailyRoll3, CAST(dow AS BIGINT) AS DayOfWeek "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY material_no ORDER BY {ORDER_DESC}) AS rn "
        "FROM feat WHERE material_no IS NOT NULL) WHERE rn = 1")
    ahead = ", ".join([f"(SELECT avg(day_total) FROM DI WHERE day_idx >= idx - {n}) AS n_DailyRoll{n}" for n in (2, 3, 5, 7)]
                      + [f"(SELECT sum(power({_beta(s)}, idx - day_idx - 1) * day_total) / sum(power({_beta(s)}, idx - day_idx - 1)) FROM DI) AS n_DailyEWM{s}" for s in (3, 5)])
    fresh = {f"DailyRoll{n}": f"n_DailyRoll{n}" for n in (2, 3, 5, 7)} | {f"DailyEWM{s}": f"n_DailyEWM{s}" for s in (3, 5)} | {
        "PrevDayTotalSale": "prev", "PrevDayTotalQty": "prev_qty", "PrevDayRowCount": "prev_n", "DailyMomentum": "prev - n_DailyRoll3",
        "DailyTrend3v7": "n_DailyRoll3 / nullif(n_DailyRoll7 + 1, 0)", "PrevDayXPrice": "prev * ppu", "PrevDayXQty": "prev * sal_qty",
        "DailyRoll3XQty": "n_DailyRoll3 * sal_qty", "DailyRoll3XPrice": "n_DailyRoll3 * ppu", "DailyEWM3XQty": "n_DailyEWM3 * sal_qty",
        "DOW_AvgDailyTotal": "n_dow", "SaleVsDOWTotal": "prev / nullif(n_dow + 1, 0)"}
    S["next_day_lags"] = "WITH " + prelude() + f""",
nx AS (SELECT max(invoice_date) + INTERVAL 1 DAY AS fd, max(day_idx) + 1 AS idx FROM DI),
st AS (SELECT d.day_total AS prev, d.day_qty AS prev_qty, CAST(d.day_count AS DOUBLE) AS prev_n, {ahead},
              coalesce((SELECT DOW_AvgDailyTotal FROM DOWA WHERE dow = isodow(fd) - 1), (SELECT global_mean FROM G)) AS n_dow
       FROM nx JOIN D0 d ON d.invoice_date = fd - INTERVAL 1 DAY)
SELECT material_no, {", ".join(f"{R(e)} AS {n}" for n, e in fresh.items())}
FROM (SELECT *, row_number() OVER (PARTITION BY material_no ORDER BY {ORDER_DESC}) AS rn FROM base WHERE material_no IS NOT NULL) CROSS JOIN st WHERE rn = 1"""
    train = f""", sp AS (SELECT *, CAST(row_number() OVER (ORDER BY {ORDER}) <= floor(count(*) OVER () * {DBL(0.8)}) AS INTEGER) AS is_train FROM feat),
prior AS (SELECT CAST(sum(sale_value) AS DOUBLE) / count(sale_value) AS prior FROM sp WHERE is_train = 1),
mat AS (SELECT material_no, CAST(sum(sale_value) AS DOUBLE) AS ms, count(sale_value) AS mn FROM sp WHERE is_train = 1 GROUP BY material_no),
md0 AS (SELECT material_no, invoice_date, sum(sale_value) AS s, count(sale_value) AS n FROM sp WHERE is_train = 1 GROUP BY 1, 2),
mdd AS (SELECT material_no, invoice_date, CAST(sum(s) OVER w AS DOUBLE) AS ds, sum(n) OVER w AS dn FROM md0
        WINDOW w AS (PARTITION BY material_no ORDER BY invoice_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
enc AS (SELECT sp.*, (coalesce(CASE WHEN is_train = 1 THEN ds ELSE ms END, 0.0) + {DBL(5.0)} * prior)
               / (coalesce(CASE WHEN is_train = 1 THEN dn ELSE mn END, 0) + {DBL(5.0)}) AS TE_Train_Mat
        FROM sp CROSS JOIN prior LEFT JOIN mat ON mat.material_no = sp.material_no
        LEFT JOIN mdd ON mdd.material_no = sp.material_no AND mdd.invoice_date = sp.invoice_date)"""
    S["train_side_encoding"] = "WITH " + prelude() + train + f"\nSELECT {_ids_sql(_pairs(['TE_Train_Mat']), [('is_train', 'is_train')])} FROM enc"
    one = lambda side, c: (f"SELECT '{side}' AS fit_on, count(*) AS n, {R(f'1 - sum((v - {c}) * (v - {c})) / nullif(var_pop(v) * count(*), 0)')} AS r2, "  # noqa: E731
                           f"{R(f'sqrt(sum((v - {c}) * (v - {c})) / count(*))')} AS rmse, {R(f'sum(abs(v - {c})) / count(*)')} AS mae FROM enc WHERE is_train = 0")
    S["encoding_holdout"] = "WITH " + prelude() + train + "\n" + one("all", "TE_Smooth_Mat") + " UNION ALL " + one("train", "TE_Train_Mat")
    S["weather_by_date"] = "WITH " + prelude() + f""",
rd AS (SELECT date_trunc('hour', ts) + to_days(CAST((event_id * 37) % 2400 - 10592 AS INTEGER)) AS t, event_id, value / 20 + 15 AS temperature,
              value / 10 + 40 AS humidity, CAST(user_id % 7 AS DOUBLE) AS wind_speed, CAST(user_id % 3 = 0 AS INTEGER) AS is_rainy
       FROM events WHERE event_type = 'signup'),
rt AS (SELECT t, arg_max(temperature, event_id) AS temperature, arg_max(humidity, event_id) AS humidity, arg_max(wind_speed, event_id) AS wind_speed,
              arg_max(is_rainy, event_id) AS is_rainy FROM rd GROUP BY t),
wx AS (SELECT b.*, coalesce(rt.temperature, 30.0) AS temperature, coalesce(rt.humidity, 68.0) AS humidity, coalesce(rt.wind_speed, 5.0) AS wind_speed,
              coalesce(rt.is_rainy, 0) AS is_rainy FROM base b ASOF LEFT JOIN rt ON b.invoice_date >= rt.t)
SELECT {_ids_sql([(c, c) for c in ('temperature', 'humidity', 'wind_speed')] + [('temperature * sal_qty', 'TempXQty'), (_traffic('dow', 'is_rainy'), 'TrafficIndex')], [('is_rainy', 'is_rainy')])} FROM wx"""
    S["split_masters"] = "WITH " + prelude() + f""",
booked AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN '1' ELSE material_no END AS material_no, sale_value FROM sales),
several AS (SELECT CAST(l.l_partkey AS VARCHAR) AS material_no, s.s_name AS vendor, r.r_name AS type
            FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN part p ON p.p_partkey = l.l_partkey
            JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT b.material_no, m.vendor, m.type, count(*) AS n_lines, {MONEY('sum(b.sale_value)')} AS total_sale
FROM booked b LEFT JOIN several m ON m.material_no = b.material_no GROUP BY 1, 2, 3"""
    S["profile"] = q(
        "SELECT count(*) AS n_rows, count(DISTINCT invoice_date) AS n_days, min(invoice_date) AS first_date, "
        "max(invoice_date) AS last_date, CAST(sum(is_festive) AS BIGINT) AS n_festive_rows, "
        "CAST(sum(CAST(dow IN (5, 6) AS INTEGER)) AS BIGINT) AS n_weekend_rows, "
        "CAST(sum(IsSeasonalProduct) AS BIGINT) AS n_seasonal_rows, "
        f"{R('min(v)')} AS target_min, {R('max(v)')} AS target_max, "
        f"{R('CAST(sum(sale_value) AS DOUBLE) / count(sale_value)')} AS target_mean FROM feat")
    S["season_counts"] = q(f"SELECT {_season_name('mon')} AS SeasonName, count(*) AS n FROM base GROUP BY 1")
    pf = "WITH " + prelude() + _product_frame()
    S["category_list"] = pf + "SELECT DISTINCT category FROM products"
    S["search_products"] = pf + (
        "SELECT * FROM products WHERE coalesce(regexp_matches(display_name, '(?i)red|steel') "
        "OR regexp_matches(category, '(?i)red|steel') OR regexp_matches(mat_description, '(?i)red|steel'), false)")
    money0 = lambda c: f"'₹' || format('{{:,.0f}}', {c})"
    S["top_products"] = pf + f"SELECT *, {money0('predicted_sale')} AS bar_text FROM products ORDER BY predicted_sale DESC NULLS LAST, material_no LIMIT 15"
    S["filtered_products"] = pf + "SELECT * FROM products WHERE category = 'STANDARD' AND is_seasonal = 1"
    S["shown_counts"] = pf + (
        "SELECT count(*) FILTER (WHERE is_seasonal = 0 AND coalesce(regexp_matches(display_name, '(?i)red|steel') "
        "OR regexp_matches(category, '(?i)red|steel') OR regexp_matches(mat_description, '(?i)red|steel'), false)) AS shown, count(*) AS total FROM products")
    S["category_summary"] = pf + (
        f"SELECT category, {R('sum(predicted_sale)')} AS total_predicted, count(*) AS n_products, "
        f"{R('avg(seasonal_lift)')} AS mean_lift FROM products GROUP BY category")
    top = "(SELECT * FROM products ORDER BY predicted_sale DESC NULLS LAST, material_no LIMIT 1)"
    next_ts = f"CAST({NEXT} AS TIMESTAMP)"
    S["product_history"] = pf + (
        f"SELECT 'actual' AS series, b.invoice_date, {MONEY('sum(b.sale_value)')} AS value FROM base b "
        f"JOIN {top} t ON b.material_no = t.material_no GROUP BY b.invoice_date "
        f"UNION ALL SELECT 'average', NULL, {MONEY('avg_sale')} FROM {top} UNION ALL SELECT 'forecast', {next_ts}, {MONEY('predicted_sale')} FROM {top}")
    S["product_row"] = pf + (
        f"SELECT p.* FROM products p JOIN {top} t ON p.display_name = t.display_name "
        "ORDER BY p.predicted_sale DESC NULLS LAST, p.material_no LIMIT 1")
    S["format_report"] = pf + (
        "SELECT material_no AS \"Mat No\", category AS \"Category\", mat_description AS \"Material Description\", "
        + "".join(f"'₹' || format('{{:,.2f}}', {c}) AS \"{label} (₹)\", " for c, label in (
            ("predicted_sale", "Pred Sale"), ("avg_price", "Avg Price"), ("last_actual", "Last Actual"), ("avg_sale", "Avg Sale")))
        + "".join(f"format('{{:,.1f}}', {c}) AS \"{label}\", " for c, label in (("predicted_qty", "Pred Qty"), ("soh", "SOH"), ("indent", "Indent")))
        + "format('{:.2f}', seasonal_lift) || '×' AS \"Seasonal Lift\", CASE WHEN is_seasonal = 1 THEN '✅' ELSE '—' END AS \"In Season\", "
        "season AS \"Season\", format('{:.2f}', traffic_index) AS \"Traffic Index\", vendor AS \"Vendor\" FROM products")
    S["day_labels"] = pf + (
        "SELECT replace(next_season, '_', ' ') AS season_label, CASE next_season WHEN 'Summer' THEN '🔥' WHEN 'SouthWest_Monsoon' THEN '🌧️' "
        "WHEN 'NorthEast_Monsoon' THEN '🌦️' WHEN 'Winter' THEN '❄️' END AS season_mark, CASE WHEN is_rainy = 1 THEN '🌧️' ELSE '☀️' END AS rain_mark, "
        f"strftime({NEXT}, '%d %b %Y') AS forecast_day, strftime({NEXT}, '%d %b') AS short_day, strftime({NEXT}, '%Y%m%d') AS file_day, "
        "strftime(min_date, '%d %b') AS first_day FROM ctx CROSS JOIN W CROSS JOIN G")
    sp = (f", sp AS (SELECT *, Mat_AvgSale AS prediction, CAST(row_number() OVER (ORDER BY {ORDER}) <= floor(count(*) OVER () * {DBL(0.8)}) AS INTEGER) AS is_train FROM feat)")
    # the total sum of squares from deviations
    figures = ("1 - sum((v - prediction) * (v - prediction)) / nullif(var_pop(v) * count(*), 0)", "sqrt(sum((v - prediction) * (v - prediction)) / count(*))",
               "sum(abs(v - prediction)) / count(*)")
    S["metrics_from_pairs"] = "WITH " + prelude() + sp + (
        "\nSELECT CAST(is_train AS BIGINT) AS is_train, count(*) AS n, "
        + ", ".join(f"{R(x)} AS {n}" for x, n in zip(figures, ("r2", "rmse", "mae"))) + " FROM sp GROUP BY is_train")
    S["history_from_pairs"] = pf + sp + (
        ", dayp AS (SELECT invoice_date, sum(prediction) AS value FROM sp GROUP BY 1), "
        "cut AS (SELECT max(invoice_date) FILTER (WHERE is_train = 1) AS a, min(invoice_date) FILTER (WHERE is_train = 0) AS b FROM sp), "
        "out AS (SELECT 'actual' AS series, invoice_date, day_total AS value FROM D0 "
        "UNION ALL SELECT 'train_predicted', invoice_date, value FROM dayp, cut WHERE invoice_date <= a "
        "UNION ALL SELECT 'test_predicted', invoice_date, value FROM dayp, cut WHERE invoice_date >= b "
        f"UNION ALL SELECT 'forecast', {next_ts}, sum(predicted_sale) FROM products)\n"
        f"SELECT series, invoice_date, {R('value')} AS value FROM out")
    S["kpi_from_pairs"] = pf + sp + (
        ", side AS (SELECT is_train, count(*) AS n, " + ", ".join(f"{x} AS {n}" for x, n in zip(figures, ("r2", "rmse", "mae"))) + " FROM sp GROUP BY is_train)\n"
        f"SELECT (SELECT {money0('sum(predicted_sale)')} FROM products) AS total_forecast_txt, "
        "max(format('{:.4f}', r2)) FILTER (WHERE is_train = 0) AS test_r2_txt, max(format('{:.4f}', r2)) FILTER (WHERE is_train = 1) AS train_r2_txt, "
        f"max({money0('rmse')}) FILTER (WHERE is_train = 0) AS rmse_txt, max({money0('mae')}) FILTER (WHERE is_train = 0) AS mae_txt, "
        "CAST(sum(n) AS BIGINT) AS n_rows, max(n) FILTER (WHERE is_train = 1) AS n_train, max(n) FILTER (WHERE is_train = 0) AS n_test FROM side")
    return S
