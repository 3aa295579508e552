"""What is staged is narrow: lines without what their own columns give, a feature table
without computed columns, last lines found before anything is joined."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tillcast.columns import SalesColumns
from tillcast.operators.enrich import enrich_joins
from tillcast.operators.ordered import exact_medians
from tillcast.operators.stage import stage
from tillcast.plans import reports
from tillcast.plans.features import FeaturePlan, feature_column
from tillcast.sources.sheets import Sheets

COLS = SalesColumns(order=("invoice_date", "line"))


def sheets(spark):
    day = dt.datetime(2024, 6, 1)
    sales = [(day + dt.timedelta(days=i % 5), f"m{i % 3}", float(i % 4 + 1), Decimal(10 + i), "c", f"s{i % 2}", "sn", f"n{i % 3}", i) for i in range(30)]
    names = "invoice_date timestamp_ntz, material_no string, sal_qty double, sale_value decimal(18,2), category string, sku string, short_name string, material_name string, line long"
    return Sheets(spark.createDataFrame(sales, names), spark.createDataFrame([("m0", "5", "1"), ("m1", "7", "2")], "sap_code string, soh string, indent string"),
                  spark.createDataFrame([("m0", "3", "1")], "material string, crt_size string, no_crts string"),
                  spark.createDataFrame([("m0", "v0", "t0", 1), ("m2", "v2", "t2", 2)], "sap_code string, vendor string, type string, sheet_row long"), COLS)


def written(df):
    return set(df.sparkSession.read.parquet(df._staged_path).columns)


def test_staged_tables_hold_no_computed_columns(spark):
    fp = FeaturePlan(sheets(spark))
    assert not written(fp.lines) & {"_v", "PricePerUnit", "Log_Price", "StockPressure", "DayOfWeek"}
    assert not written(fp.fact) & {"_v", "PricePerUnit", "TE_LOO_Mat", "Category_AvgSale", "day_total", "TempXQty"}
    assert {"Mat_AvgSale", "MatAvg_rank", "Price_rank", "Category_code"} <= written(fp.fact)
    assert {feature_column(n, COLS) for n in fp.feature_names} <= set(fp.features.columns)


def test_material_statistics_need_no_ranks(spark):
    fp = FeaturePlan(sheets(spark))
    fp.with_material(fp.with_globals(fp.base)).count()
    assert "ranks" not in vars(fp) and "M" not in vars(fp)


def test_last_features_are_those_of_the_feature_table(spark):
    fp = FeaturePlan(sheets(spark))
    assert fp.last_features.count() == 3 and "fact" not in vars(fp)
    names = [c for c in fp.features.columns if c != "_row"]
    want = reports.last_rows(fp.features, "material_no", COLS.order).select(*names)
    assert sorted(map(str, fp.last_features.select(*names).collect())) == sorted(map(str, want.collect()))


def test_last_rows_by_address(spark, monkeypatch):
    rows = [(f"k{i % 700}", i // 1400, i % 3, i) for i in range(70000)] + [(None, 99, 0, -1), ("k1", None, 0, -2)]
    df = stage(spark.createDataFrame(rows, "k string, day int, line int, x long").repartition(3).withColumn("_row", F.monotonically_increasing_id()), "addressed")
    want = sorted(map(tuple, reports.last_rows(df, "k", ["day", "line"]).collect()))
    monkeypatch.setattr(reports, "BROADCAST_MAX_BYTES", 0)
    got = reports.last_rows(df, "k", ["day", "line"], "_row")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 700


def test_masters_joined_first_multiply_lines_alike(spark):
    s = sheets(spark)
    twice = lambda df: df.unionAll(df).unionAll(df.limit(1)).unionAll(df.limit(1).withColumn(df.columns[0], F.lit(None)))
    sales = s.sales.unionByName(s.sales.limit(1).withColumn("material_no", F.lit(None)))
    sku, ind, crt = map(twice, (s.sku_buy, s.indent, s.crt_size))
    got = enrich_joins(sales, sku, ind, crt, COLS)
    n = lambda df, k: {r[0]: r[1] for r in df.where(F.col(k).isNotNull()).groupBy(k).count().collect()}
    per = [n(sku, "sap_code"), n(ind, "sap_code"), n(crt, "material")]
    lines = {r[0]: r[1] for r in sales.groupBy("material_no").count().collect()}
    want = {k: c * max(1, per[0].get(k, 0)) * max(1, per[1].get(k, 0)) * max(1, per[2].get(k, 0)) for k, c in lines.items()}
    assert {r[0]: r[1] for r in got.groupBy("material_no").count().collect()} == want


def test_medians_of_small_and_large_groups(spark):
    rows = [("a", float(i % 97), float(i)) for i in range(501)] + [("b", 2.0, None), ("b", 5.0, None), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    specs = [("v", "k", "v"), ("w", "k", "w"), ("all", None, "v")]
    runs = [sorted(map(tuple, exact_medians(df, specs, small=n).collect())) for n in (0, 100, 10000)]
    assert runs[0] == runs[1] == runs[2] and ("v", "b", 3.5) in runs[0] and ("w", "a", 250.0) in runs[0] and len(runs[0]) == 4
