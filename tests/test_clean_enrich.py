"""Cleaning, joins, fills, product labels, split (FIXTURES.md section 2)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tillcast.columns import SalesColumns
from tillcast.operators.clean import clean_indent
from tillcast.operators.enrich import enrich_joins, fill_defaults, master_multiplicity, product_meta, soh_median
from tillcast.operators.split import split_bounds, time_split
from tillcast.plans.features import FeaturePlan
from tillcast.plans.reports import last_rows
from tillcast.sources.sheets import Sheets

COLS = SalesColumns(short_name=None, material_name=None, order=("invoice_date", "line"))


def _sheets(spark, sales_rows, sku_rows, indent_rows, crt_rows):
    sales_rows = [(r[0], r[1], r[2], Decimal(r[3]), *r[4:]) for r in sales_rows]
    sales = spark.createDataFrame(sales_rows, "invoice_date timestamp, material_no string, sal_qty double, "
                                              "sale_value decimal(18,2), category string, sku string, line int")
    sku = spark.createDataFrame(sku_rows, "sap_code string, vendor string, type string, description string, "
                                          "category_label string, sheet_row long")
    ind = spark.createDataFrame(indent_rows, "sap_code string, soh string, indent string")
    crt = spark.createDataFrame(crt_rows, "material string, crt_size string, no_crts string")
    return Sheets(sales, ind, crt, sku, COLS)


def test_bad_numbers(spark):
    df = spark.createDataFrame([("1", "-", "2"), ("2", "", None), ("3", " 12 ", "x"), ("4", "12d", "0x1p3"), ("5", "+.5e1", "1f"), ("6", "1_0", "-2.")],
                               "sap_code string, soh string, indent string")
    assert [(r.soh, r.indent) for r in clean_indent(df).orderBy("sap_code").collect()] == \
        [(0.0, 2.0), (0.0, 0.0), (12.0, 0.0), (0.0, 0.0), (5.0, 0.0), (0.0, -2.0)]


def test_unmatched_keys_and_duplicate_master(spark):
    t = dt.datetime(2025, 1, 1)
    sh = _sheets(spark,
                 [(t, "1", 2.0, 10, "c", "s", 1), (t, "2", 1.0, 5, "c", "s", 2), (t, "3", 1.0, 7, "c", "s", 3)],
                 [("1", "V1", "T1", "d1", "C1", 1), ("1", "V2", "T2", "d2", "C2", 2), ("3", "V3", "T3", "d3", "C3", 3)],
                 [("1", "10", "1"), ("3", "30", "2")], [("1", "4", "2")])
    j = enrich_joins(sh.sales, sh.sku_buy, sh.indent, sh.crt_size, COLS)
    assert j.count() == 4  # the duplicated master row doubles material 1
    med = soh_median(sh.sales, sh.sku_buy, sh.indent, sh.crt_size, COLS)
    f = {(r.material_no, r.vendor): r for r in fill_defaults(j, COLS, med).collect()}
    r2 = f[("2", "UNKNOWN")]
    assert (r2.type, r2.soh, r2.indent, r2.crt_size, r2.no_crts) == ("UNKNOWN_VENDOR", 10.0, 0.0, 1.0, 1.0)
    meta = {r.material_no: r for r in product_meta(sh.sku_buy).collect()}
    assert meta["1"].vendor_name == "V1" and meta["1"].display_name == "C1 — d1"
    dedup = enrich_joins(sh.sales, sh.sku_buy, sh.indent, sh.crt_size, COLS, dedup_masters=True)
    assert dedup.count() == 3


def test_split_inside_day(spark):
    days = [1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    rows = [(dt.datetime(2025, 1, d), i) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "invoice_date timestamp, line int")
    s = time_split(df, "invoice_date", ["invoice_date", "line"]).orderBy("line").collect()
    assert [r.is_train for r in s] == [1] * 8 + [0] * 2
    b = split_bounds(time_split(df, "invoice_date", ["invoice_date", "line"]), "invoice_date").first()
    assert (b.n_train, b.n_test) == (8, 2)
    assert b.last_train_date == b.first_test_date == dt.datetime(2025, 1, 8)


def test_lines_without_a_date_are_the_last(spark):
    rows = [(dt.datetime(2025, 1, d), d) for d in range(1, 8)] + [(None, 90), (None, 91), (None, 92)]
    df = spark.createDataFrame(rows, "invoice_date timestamp, line int")
    got = {r.line: r.is_train for r in time_split(df, "invoice_date", ["invoice_date", "line"]).collect()}
    assert got == {**{d: 1 for d in range(1, 8)}, 90: 1, 91: 0, 92: 0}


def test_last_row_is_one_however_many_tie(spark):
    rows = [("m", 1, "V1", 2.0), ("m", 2, "V1", 3.0), ("m", 2, "V2", 3.0), ("m", 2, "V2", 3.0), ("n", 1, None, None), (None, 9, "x", 1.0)]
    df = spark.createDataFrame(rows, "material_no string, line int, vendor string, v double")
    got = sorted(tuple(r) for r in last_rows(df, "material_no", ["line"]).collect())
    assert got == [("m", 2, "V2", 3.0), ("n", 1, None, None)]
    assert [tuple(r) for r in last_rows(df, None, ["line"]).collect()] == [(None, 9, "x", 1.0)]


def test_duplicate_masters_give_one_product_row(spark):
    t = dt.datetime(2025, 1, 1)
    sh = _sheets(spark, [(t, "1", 2.0, 10, "c", "s", 1), (t, "2", 1.0, 5, None, "s", 2)],
                 [("1", "V1", "T1", "d1", "C1", 1), ("1", "V2", "T2", "d2", "C2", 2)], [("1", "10", "1")], [("1", "4", "2")])
    fp = FeaturePlan(sh)
    assert fp.base.count() == 3
    assert sorted(r.material_no for r in last_rows(fp.features, "material_no", COLS.order).collect()) == ["1", "2"]
    assert [tuple(r) for r in master_multiplicity(fp.sales, sh.sku_buy, COLS).orderBy("material_no").collect()] == [("1", 1, 2, 2), ("2", 1, 0, 1)]
    # a missing category is a class of its own, or the text 'nan' where asked for
    codes = {r.material_no: r.Category_code for r in fp.features.select("material_no", "Category_code").distinct().collect()}
    assert codes == {"1": 0, "2": 1}
    legacy = FeaturePlan(sh, legacy_nan_text=True)
    assert {r.category for r in legacy.base.collect()} == {"c", "nan"}


def test_zero_qty_price_and_single_row_group(spark):
    t = dt.datetime(2025, 1, 1)
    sh = _sheets(spark,
                 [(t, "1", 0.0, 10, "c", "s", 1), (t + dt.timedelta(days=1), "1", None, 10, "c", "s", 2),
                  (t + dt.timedelta(days=2), "1", 4.0, 10, "c", "s", 3), (t + dt.timedelta(days=3), "9", 1.0, 6, "c", "s", 4)],
                 [("1", "V", "T", "d", "C", 1)], [("1", "5", "1")], [("1", "1", "1")])
    fp = FeaturePlan(sh)
    f = fp.with_daily(fp.with_material(fp.with_globals(fp.base))).orderBy("line").collect()
    assert [r.PricePerUnit for r in f] == [10.0, 10.0, 2.5, 6.0]
    assert [r.QtyXPrice for r in f][:3] == [0.0, None, 10.0]
    single = f[3]
    assert single.Mat_StdSale == 0.0 and single.TE_LOO_Mat == 0.0 and single.DateLOO_Mean == 0.0


def test_loo_property(spark):
    """LOO * (n - 1 + 1e-9) + v equals the group sum."""
    from tests.conftest import SF_SMALL
    from tillcast.catalog import plan
    fp = plan(spark, SF_SMALL)
    f = fp.with_material(fp.with_globals(fp.base))
    bad = f.where(F.abs(F.col("TE_LOO_Mat") * (F.col("Mat_Count") - 1 + 1e-9) + F.col("_v") - F.col("Mat_SumSale")) > 1e-3)
    assert bad.count() == 0


def test_repartitioned_input_same_results(spark):
    """Input partitioning does not change statistics, encodings or the split."""
    from dataclasses import replace as dc_replace

    from tests.conftest import SF_SMALL
    from tillcast.operators.split import time_split
    from tillcast.sources.sheets import tpch_sheets
    a = tpch_sheets(spark, SF_SMALL)
    b = dc_replace(a, sales=a.sales.repartition(7, "l_suppkey"))
    out = []
    for sh in (a, b):
        fp = FeaturePlan(sh)
        f = fp.with_material(fp.with_globals(fp.base))
        f = time_split(f, "invoice_date", sh.cols.order)
        out.append(f.select("l_orderkey", "l_linenumber", "material_no", "l_suppkey", "Mat_AvgSale",
                            "Mat_MedSale", "TE_LOO_Mat", "Mat_SeasonAvgSale", "is_train").toPandas()
                   .sort_values(["l_orderkey", "l_linenumber", "material_no", "l_suppkey", "is_train"])
                   .reset_index(drop=True))
    assert out[0].equals(out[1])
