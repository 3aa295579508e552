"""Workbook sheets as DataFrames.

``read_sheets`` reads a landing folder with one table per sheet and maps the
sheet columns onto :class:`SalesColumns` names. ``tpch_sheets`` builds the
same four inputs from the star-schema test tables (SURVEY 7.3).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.columns import SalesColumns
from tillcast.sources import schemas

# Candidate names of optional sku_buy columns, first existing wins (fixed values).
DESCRIPTION_CANDIDATES = ["Material Description", "Material description",
                          "MATERIAL DESCRIPTION", "Material Name", "Material name"]
CATEGORY_CANDIDATES = ["Category", "CATEGORY", "category"]

# Columns that make the order of the adapter's invoice lines total.
TPCH_ORDER = ("invoice_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
              "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
TPCH_IDS = ["l_orderkey", "l_linenumber", "material_no", "l_suppkey"]


@dataclass
class Sheets:
    sales: DataFrame     # SalesColumns names + order columns
    indent: DataFrame    # sap_code, soh (text), indent (text)
    crt_size: DataFrame  # material, crt_size (text), no_crts (text)
    sku_buy: DataFrame   # sap_code, vendor, type, description?, category_label?, sheet_row
    cols: SalesColumns


def first_existing(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def sheet_order(df: DataFrame):
    """A row's place in the sheet: its ``Row`` column, or else the file, the
    block of the file and the place within the block that it was read from."""
    if "Row" in df.columns:
        return F.col("Row").cast("long")
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def _read(spark: SparkSession, root: str, sheet: str, fmt: str) -> DataFrame:
    """A landed sheet with its columns found by name, cast to the declared
    types, and ``sheet_row``; a required column that is missing is an error."""
    path = os.path.join(root, f"{sheet}.{fmt}")
    df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    fields = schemas.SHEET_SCHEMAS[sheet].fields
    missing = [f.name for f in fields if f.name not in df.columns and f.name not in schemas.OPTIONAL.get(sheet, ())]
    if missing:
        raise ValueError(f"sheet {sheet!r} lacks {', '.join(missing)}")
    types = {f.name: f.dataType for f in fields}
    others = [c for c in df.columns if c in DESCRIPTION_CANDIDATES + CATEGORY_CANDIDATES and c not in types]
    cols = [F.col(f"`{n}`").try_cast(t).alias(n) for n, t in types.items() if n in df.columns]
    return df.select(*cols, *[F.col(f"`{c}`").cast("string").alias(c) for c in others], sheet_order(df).alias("sheet_row"))


def read_sheets(spark: SparkSession, root: str, fmt: str = "parquet") -> Sheets:
    """Read ``<root>/<sheet>.<fmt>`` for the four sheets."""
    sales = _read(spark, root, "SALES DATA", fmt)
    cols = SalesColumns(
        short_name="short_name" if "Short Name" in sales.columns else None,
        material_name="material_name" if "Material name" in sales.columns else None,
        order=("invoice_date", "sheet_row"),
    )
    ren = {"Invoice Date": "invoice_date", "Material No": "material_no", "SalQty": "sal_qty",
           "SaleValue": "sale_value", "Category": "category", "SKU": "sku",
           "Short Name": "short_name", "Material name": "material_name", "sheet_row": "sheet_row"}
    sales = sales.select(*[F.col(f"`{k}`").alias(v) for k, v in ren.items() if k in sales.columns])
    indent = _read(spark, root, "INDENT", fmt).select(
        F.col("`SAP Code`").alias("sap_code"), F.col("SOH").alias("soh"), F.col("Indent").alias("indent"))
    crt = _read(spark, root, "crt size", fmt).select(
        F.col("Material").alias("material"), F.col("`Crt Size`").alias("crt_size"),
        F.col("`No Crts`").alias("no_crts"))
    sku = _read(spark, root, "SKU buy area", fmt)
    desc = first_existing(sku, DESCRIPTION_CANDIDATES)
    cat = first_existing(sku, CATEGORY_CANDIDATES)
    sel = [F.col("`SAP Code`").alias("sap_code"), F.col("VENDOR").alias("vendor"),
           F.col("TYPE").alias("type"), "sheet_row"]
    if desc:
        sel.append(F.col(f"`{desc}`").alias("description"))
    if cat:
        sel.append(F.col(f"`{cat}`").alias("category_label"))
    return Sheets(sales, indent, crt, sku.select(*sel), cols)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tpch_sheets(spark: SparkSession, sf_dir: str) -> Sheets:
    """The four sheets built from the star-schema tables (whole tables).

    * SALES DATA: every lineitem with its order and part; Invoice Date =
      o_orderdate, Material No = l_partkey, SalQty = l_quantity, SaleValue =
      l_extendedprice, Category = p_type, SKU = p_brand, Short Name = p_name,
      Material name = p_name#p_partkey.
    * SKU buy area: every part sold, vendor = name of the part's lowest
      supplier key seen in lineitem, TYPE = region of that supplier.
    * INDENT: every part; SOH is text (p_size*10, padded with blanks, or '-'
      above size 40, so lenient casts really occur), Indent = p_size div 4 as text.
    * crt size: every part; Crt Size = p_size, No Crts = p_size div 10 + 1, as text.
    """
    li = load_table(spark, sf_dir, "lineitem")
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    part = load_table(spark, sf_dir, "part")
    # by the text that the masters are joined on later, as it is trimmed there: the lines
    # are dealt out by it once, before they have the part's texts
    text_key = lambda c: F.trim(F.trim(F.col(c).cast("string")))
    texts = part.select(text_key("p_partkey").alias("_part"), "p_partkey", "p_type", "p_brand", "p_name").hint("merge")
    sales = (li.join(orders, li.l_orderkey == orders.o_orderkey)
             .join(texts, text_key("l_partkey") == F.col("_part"))
             .select(
                 F.col("o_orderdate").alias("invoice_date"),
                 F.col("l_partkey").cast("string").alias("material_no"),
                 F.col("l_quantity").cast("double").alias("sal_qty"),
                 F.col("l_extendedprice").cast("decimal(18,2)").alias("sale_value"),
                 F.col("p_type").alias("category"),
                 F.col("p_brand").alias("sku"),
                 F.col("p_name").alias("short_name"),
                 F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("material_name"),
                 "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    main_supp = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("supp"))
    sku = _master(spark, sf_dir, part, main_supp).withColumn("sheet_row", F.col("sap_code").cast("long"))
    indent = (part
              .select(F.col("p_partkey").cast("string").alias("sap_code"),
                      F.when(F.col("p_size") > 40, F.lit("-"))
                       .otherwise(F.concat(F.lit(" "), (F.col("p_size") * 10).cast("string"), F.lit(" ")))
                       .alias("soh"),
                      (F.col("p_size") / 4).cast("int").cast("string").alias("indent")))
    crt = (part
           .select(F.col("p_partkey").cast("string").alias("material"),
                   F.col("p_size").cast("string").alias("crt_size"),
                   ((F.col("p_size") / 10).cast("int") + 1).cast("string").alias("no_crts")))
    cols = SalesColumns(order=TPCH_ORDER)
    return Sheets(sales, indent, crt, sku, cols)


def _master(spark: SparkSession, sf_dir: str, part: DataFrame, supplied: DataFrame) -> DataFrame:
    """Vendor-master rows of (l_partkey, supp) pairs."""
    supplier = load_table(spark, sf_dir, "supplier")
    nation = load_table(spark, sf_dir, "nation")
    region = load_table(spark, sf_dir, "region")
    return (part.join(supplied, part.p_partkey == supplied.l_partkey)
            .join(supplier, F.col("supp") == supplier.s_suppkey)
            .join(nation, F.col("s_nationkey") == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey)
            .select(F.col("p_partkey").cast("string").alias("sap_code"),
                    F.col("s_name").alias("vendor"), F.col("r_name").alias("type"),
                    F.col("p_name").alias("description"), F.col("p_type").alias("category_label"),
                    F.col("supp").cast("long").alias("supp")))


def tpch_all_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor master with a row for every (part, supplier) pair sold, in the
    order of suppliers from the highest key down: several rows a material."""
    pairs = load_table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("supp")).distinct()
    rows = _master(spark, sf_dir, load_table(spark, sf_dir, "part"), pairs)
    return rows.withColumn("sheet_row", -F.col("supp")).drop("supp")


def tpch_weather_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed history of weather readings on the sales calendar, from the
    sign-up events: each is moved by whole days, so that days without a reading
    and several readings at one time occur."""
    e = load_table(spark, sf_dir, "events").where("event_type = 'signup'")
    moved = F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.make_dt_interval((F.pmod(F.col("event_id") * 37, F.lit(2400)) - 10592).cast("int"))
    return e.select(moved.alias("reading_time"), "event_id", (F.col("value") / 20 + 15).alias("temperature"), (F.col("value") / 10 + 40).alias("humidity"),
                    F.pmod("user_id", F.lit(7)).cast("double").alias("wind_speed"), (F.pmod("user_id", F.lit(3)) == 0).cast("int").alias("is_rainy"))
