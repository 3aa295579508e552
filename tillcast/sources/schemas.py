"""Explicit schemas of the four workbook sheets and the weather payload.

Sheets are landed as one table per sheet (Parquet or CSV, see
:func:`tillcast.sources.sheets.read_sheets`); nothing is inferred.
"""

from pyspark.sql import types as T

SALES = T.StructType([
    T.StructField("Invoice Date", T.StringType()),   # day-first text or timestamp text
    T.StructField("Material No", T.StringType()),
    T.StructField("SalQty", T.DoubleType()),
    T.StructField("SaleValue", T.DecimalType(20, 4)),
    T.StructField("Category", T.StringType()),
    T.StructField("SKU", T.StringType()),
    T.StructField("Short Name", T.StringType()),
    T.StructField("Material name", T.StringType()),
])

INDENT = T.StructType([
    T.StructField("SAP Code", T.StringType()),
    T.StructField("SOH", T.StringType()),
    T.StructField("Indent", T.StringType()),
])

CRT_SIZE = T.StructType([
    T.StructField("Material", T.StringType()),
    T.StructField("Crt Size", T.StringType()),
    T.StructField("No Crts", T.StringType()),
])

SKU_BUY = T.StructType([
    T.StructField("SAP Code", T.StringType()),
    T.StructField("VENDOR", T.StringType()),
    T.StructField("TYPE", T.StringType()),
    T.StructField("Material Description", T.StringType()),
    T.StructField("Category", T.StringType()),
])

# Columns that a sheet may lack (fixed names); all others are required.
OPTIONAL = {"SALES DATA": {"Short Name", "Material name"}, "SKU buy area": {"Material Description", "Category"}}

# One landed record per city: the HTTP status and the raw JSON body.
WEATHER_RECORD = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])

WEATHER_PAYLOAD = T.StructType([
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
    ])),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType())])),
    T.StructField("rain", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("weather", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType())]))),
])

SHEET_SCHEMAS = {
    "SALES DATA": SALES,
    "INDENT": INDENT,
    "crt size": CRT_SIZE,
    "SKU buy area": SKU_BUY,
}
