"""Landed workbook sheets (S1, S2, P4, P13, Q21) through the whole plan."""

import datetime as dt
import os
from decimal import Decimal

import pytest

from tillcast.plans.features import FEATURES, FeaturePlan
from tillcast.sources.sheets import read_sheets


def test_read_landed_sheets_and_plan(spark, tmp_path):
    root = str(tmp_path / "landing")
    sales = [("01/03/2025", "100", 2.0, Decimal("10.00"), "Veg", "S1", "Tomato"),
             ("02/03/2025", "100", 1.0, Decimal("6.00"), "Veg", "S1", "Tomato"),
             ("02/03/2025", "200", 3.0, Decimal("9.00"), "Fruit", "S2", "Apple"),
             ("04/03/2025", "300", 1.0, None, "Fruit", "S2", "Pear")]
    spark.createDataFrame(sales, "`Invoice Date` string, `Material No` string, SalQty double, "
                                 "SaleValue decimal(18,2), Category string, SKU string, `Material name` string") \
        .write.parquet(os.path.join(root, "SALES DATA.parquet"))
    spark.createDataFrame([("100", " 5 ", "1"), ("200", "-", "x")], "`SAP Code` string, SOH string, Indent string") \
        .write.parquet(os.path.join(root, "INDENT.parquet"))
    spark.createDataFrame([("100", "4", "2")], "Material string, `Crt Size` string, `No Crts` string") \
        .write.parquet(os.path.join(root, "crt size.parquet"))
    spark.createDataFrame([("100", "V1", "T1", "Red tomato", "VEG"), ("200", "V2", "T2", "Green apple", "FRUIT")],
                          "`SAP Code` string, VENDOR string, TYPE string, `Material description` string, "
                          "CATEGORY string").write.parquet(os.path.join(root, "SKU buy area.parquet"))
    sheets = read_sheets(spark, root)
    assert sheets.cols.short_name is None and sheets.cols.material_name == "material_name"
    fp = FeaturePlan(sheets)
    assert fp.quarantine.count() == 1          # the line without a target
    f = fp.features
    assert f.count() == 3
    row = f.where("material_no = '100'").orderBy("invoice_date").first()
    assert row.invoice_date == dt.datetime(2025, 3, 1)
    assert (row.SN_AvgSale, row.SN_SumSale, row.SN_AvgPrice, row.SN_AvgQty) == (0.0, 0.0, 0.0, 0.0)
    assert row.soh == 5.0
    assert len(FEATURES) == 141 and set(FEATURES) - set(fp.feature_names) == {"Short Name"}
    meta = {r.material_no: r.display_name for r in fp.meta.collect()}
    assert meta == {"100": "VEG — Red tomato", "200": "FRUIT — Green apple"}


def _landing(spark, root, fmt, sales_cols, sku_cols):
    """The four sheets under ``root``, with the sales and master columns in the given order."""
    sales = {"Invoice Date": "01/03/2025", "Material No": "100", "SalQty": "2", "SaleValue": "10.555", "Category": "Veg",
             "SKU": "S1", "Short Name": "Tom", "Material name": "Tomato"}
    sku = {"SAP Code": "100", "VENDOR": "V1", "TYPE": "T1", "Material Description": "Red", "Category": "CAT"}
    sheets = {"SALES DATA": [{c: sales[c] for c in sales_cols}, {c: {**sales, "Invoice Date": "31/31/2025"}[c] for c in sales_cols}],
              "INDENT": [{"SAP Code": "100", "SOH": "12d", "Indent": "1"}], "crt size": [{"Material": "100", "Crt Size": "4", "No Crts": "2"}],
              "SKU buy area": [{c: sku[c] for c in sku_cols}]}
    for name, rows in sheets.items():
        df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in rows[0])).select(*[f"`{c}`" for c in rows[0]]).repartition(2)
        path = os.path.join(root, f"{name}.{fmt}")
        df.write.option("header", True).csv(path) if fmt == "csv" else df.write.parquet(path)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_columns_are_found_by_name(spark, tmp_path, fmt):
    _landing(spark, str(tmp_path), fmt, ["SKU", "Material name", "SaleValue", "Material No", "SalQty", "Category", "Invoice Date"],
             ["TYPE", "Category", "VENDOR", "SAP Code"])
    sheets = read_sheets(spark, str(tmp_path), fmt)
    assert sheets.cols.short_name is None
    fp = FeaturePlan(sheets)
    line = fp.base.first()
    assert (line.material_no, line.material_name, line.vendor, line.type, line.sale_value) == ("100", "Tomato", "V1", "T1", Decimal("10.5550"))
    assert line.soh == 0.0  # '12d' is no number
    assert [(r.reason, r.material_no) for r in fp.quarantine.collect()] == [("no date", "100")]


def test_a_required_column_that_is_missing_is_an_error(spark, tmp_path):
    _landing(spark, str(tmp_path), "csv", ["SKU", "SaleValue", "Material No", "SalQty", "Invoice Date"], ["TYPE", "VENDOR", "SAP Code"])
    with pytest.raises(ValueError, match="Category"):
        read_sheets(spark, str(tmp_path), "csv")


def test_rows_keep_sheet_order_over_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / "SKU buy area.csv").mkdir(exist_ok=True)
        (tmp_path / "SKU buy area.csv" / f"part-{k}.csv").write_text("SAP Code,VENDOR,TYPE\n" + "".join(f"{c},V{k}{j},T\n" for j, c in enumerate("aab")))
    from tillcast.operators.enrich import first_per_key
    from tillcast.sources.sheets import _read
    got = first_per_key(_read(spark, str(tmp_path), "SKU buy area", "csv"), "SAP Code", "sheet_row", ["VENDOR"])
    assert {r["SAP Code"]: r.VENDOR for r in got.collect()} == {"a": "V00", "b": "V02"}
