"""Left joins of the invoice lines to the master sheets and the fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.columns import SalesColumns
from tillcast.operators.clean import clean_crt_size, clean_indent, strip_text
from tillcast.operators.joins import with_scalars
from tillcast.operators.ordered import exact_median

# Fill values after the joins (fixed values).
FILL_INDENT, FILL_CRT_SIZE, FILL_NO_CRTS = 0.0, 1.0, 1.0
FILL_VENDOR, FILL_TYPE = "UNKNOWN", "UNKNOWN_VENDOR"
# Product labels when a material has no master row (fixed values).
META_CATEGORY_DEFAULT, META_DESCRIPTION_DEFAULT = "Unknown", ""
LABEL_SEPARATOR = " — "


def _key(c: str):
    """Join keys compared as trimmed text on both sides (Q2)."""
    return F.trim(F.col(c).cast("string"))


def first_per_key(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Keep the first row per key in ``order`` (A20) with a partial aggregate,
    so a key with very many rows is combined map-side, not buffered."""
    picked = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def enrich_joins(sales: DataFrame, sku_buy: DataFrame, indent: DataFrame, crt: DataFrame,
                 cols: SalesColumns, dedup_masters: bool = False, legacy_nan_text: bool = False) -> DataFrame:
    """Left joins on the material key; duplicated master rows multiply
    the invoice lines unless ``dedup_masters`` (Q3). Adds match flags.

    The masters are joined with each other first (full outer joins, so each key has as
    many rows as its masters' rows multiply to) and the lines are joined once."""
    sku = strip_text(sku_buy, legacy_nan_text).select(_key("sap_code").alias("_k"), F.col("vendor"),
                                     F.col("type"), F.lit(1).alias("_sku_hit"), "sheet_row")
    if dedup_masters:
        sku = first_per_key(sku, "_k", "sheet_row", ["vendor", "type", "_sku_hit"])
    else:
        sku = sku.drop("sheet_row")
    ind = clean_indent(indent).select(_key("sap_code").alias("_k"), "soh", "indent",
                                      F.lit(1).alias("_indent_hit"))
    crt_ = clean_crt_size(crt).select(_key("material").alias("_k"), "crt_size", "no_crts")
    f = sales.withColumn("_k", _key(cols.material))
    known = [m.where(F.col("_k").isNotNull()) for m in (sku, ind, crt_)]   # a missing key finds nothing
    f = f.join(known[0].join(known[1], "_k", "full_outer").join(known[2], "_k", "full_outer"), "_k", "left")
    return f.drop("_k").withColumnRenamed("vendor", cols.vendor).withColumnRenamed("type", cols.type) \
        .withColumnRenamed("soh", cols.soh).withColumnRenamed("indent", cols.indent) \
        .withColumnRenamed("crt_size", cols.crt_size).withColumnRenamed("no_crts", cols.no_crts)


def soh_median(sales: DataFrame, sku_buy: DataFrame, indent: DataFrame, crt: DataFrame,
               cols: SalesColumns, dedup_masters: bool = False) -> DataFrame:
    """One row: exact median of SOH over the joined lines (0 when none).

    Computed before the joins: a stock row counts as often as its material has
    lines, times the other masters' rows that multiply them."""
    rows = lambda df, name, n: df.groupBy(_key(name).alias("_k")).agg(F.count(F.lit(1)).alias(n))
    lines = rows(sales, cols.material, "_lines").where(F.col("_k").isNotNull())
    sku_n, crt_n = rows(strip_text(sku_buy), "sap_code", "_skus"), rows(strip_text(crt), "material", "_crts")
    ind = clean_indent(indent).select(_key("sap_code").alias("_k"), "soh")
    times = F.lit(1) if dedup_masters else F.coalesce("_skus", F.lit(1))
    f = ind.join(lines, "_k").join(sku_n, "_k", "left").join(crt_n, "_k", "left")
    f = f.select("soh", (F.col("_lines") * times * F.coalesce("_crts", F.lit(1))).alias("_weight"))
    return median_or_zero(f, "soh", "_weight")


def median_or_zero(f: DataFrame, soh: str, weight: str | None = None) -> DataFrame:
    """One row: exact median of a stock column, 0 where it has no value."""
    med = exact_median(f, [], soh, "median_soh", weight=weight)
    one = f.sparkSession.range(1).select(F.lit(0.0).alias("_none"))
    return one.join(F.broadcast(med), how="left").select(F.coalesce("median_soh", "_none").alias("median_soh"))


def fill_defaults(enriched: DataFrame, cols: SalesColumns, median: DataFrame) -> DataFrame:
    """Unmatched stock -> median SOH (a one-row frame), Indent 0; crates 1;
    vendor and type defaults only where the vendor master had no row (Q1)."""
    f = with_scalars(enriched, median, ["median_soh"])
    unmatched = F.col("_sku_hit").isNull()
    return f.select(
        *[c for c in enriched.columns if c not in {cols.soh, cols.indent, cols.crt_size,
                                                  cols.no_crts, cols.vendor, cols.type}],
        F.when(unmatched, F.lit(FILL_VENDOR)).otherwise(F.col(cols.vendor)).alias(cols.vendor),
        F.when(unmatched, F.lit(FILL_TYPE)).otherwise(F.col(cols.type)).alias(cols.type),
        F.coalesce(F.col(cols.soh), F.col("median_soh")).alias(cols.soh),
        F.coalesce(F.col(cols.indent), F.lit(FILL_INDENT)).alias(cols.indent),
        F.coalesce(F.col(cols.crt_size), F.lit(FILL_CRT_SIZE)).alias(cols.crt_size),
        F.coalesce(F.col(cols.no_crts), F.lit(FILL_NO_CRTS)).alias(cols.no_crts),
    )


def product_meta(sku_buy: DataFrame) -> DataFrame:
    """A20 + P7: first master row per code -> labels for the report."""
    s = strip_text(sku_buy)
    cat = F.col("category_label") if "category_label" in s.columns else F.lit(META_CATEGORY_DEFAULT)
    desc = F.col("description") if "description" in s.columns else F.lit(META_DESCRIPTION_DEFAULT)
    s = s.select(_key("sap_code").alias("material_no"), cat.alias("category_label"),
                 desc.alias("mat_description"), F.col("vendor").alias("vendor_name"), "sheet_row")
    first = first_per_key(s, "material_no", "sheet_row",
                          ["category_label", "mat_description", "vendor_name"])
    return first.withColumn("display_name", F.concat(F.col("category_label"), F.lit(LABEL_SEPARATOR),
                                                     F.col("mat_description")))


def master_multiplicity(sales: DataFrame, sku_buy: DataFrame, cols: SalesColumns) -> DataFrame:
    """Q3: per material its invoice lines, its vendor-master rows, and the lines
    after the join, which duplicated master rows multiply."""
    n = lambda df, name, out: df.groupBy(_key(name).alias("material_no")).agg(F.count(F.lit(1)).alias(out))
    f = n(sales, cols.material, "n_lines").join(n(strip_text(sku_buy), "sap_code", "n_master_rows"), "material_no", "left")
    rows = F.coalesce("n_master_rows", F.lit(0))
    return f.select("material_no", "n_lines", rows.alias("n_master_rows"),
                    (F.col("n_lines") * F.greatest(rows, F.lit(1))).alias("n_joined_lines"))
