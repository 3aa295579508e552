"""Cleaning: strip text, parse day-first dates, lenient numbers, NaN -> NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.calendar import parse_dayfirst
from tillcast.functions.numeric import lenient_double, nan_to_null


def strip_text(df: DataFrame, legacy_nan_text: bool = False) -> DataFrame:
    """Trim every string column in one projection.

    A missing cell stays NULL; ``legacy_nan_text=True`` turns it into the text
    'nan' the way ``astype(str)`` does in the reference (so blank keys match).
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.trim(c)
            if legacy_nan_text:
                c = F.coalesce(c, F.lit("nan"))
        out.append(c.alias(f.name))
    return df.select(*out)


def clean_sales(sales: DataFrame, date: str, qty: str, legacy_nan_text: bool = False) -> DataFrame:
    """Strip text, parse the date day-first (no-op on timestamps), NaN qty -> NULL."""
    dt_type = sales.schema[date].dataType
    if not isinstance(dt_type, (T.TimestampType, T.TimestampNTZType)):
        sales = sales.withColumn(date, parse_dayfirst(date))
    df = strip_text(sales, legacy_nan_text)
    return df.withColumn(qty, nan_to_null(F.col(qty).cast("double")))


def split_valid(sales: DataFrame, value: str, date: str):
    """(usable rows, rows without a target or a readable date, with the
    ``reason``): the target is never filled (Q21), and a line that has no place
    in time cannot be split, so neither is dropped unseen."""
    reason = F.when(F.col(value).isNull(), "no target").when(F.col(date).isNull(), "no date")
    return sales.where(reason.isNull()), sales.withColumn("reason", reason).where(F.col("reason").isNotNull())


def clean_indent(indent: DataFrame) -> DataFrame:
    """INDENT: key trimmed, SOH and Indent lenient numbers with default 0."""
    return strip_text(indent).select(
        "sap_code",
        lenient_double("soh", 0.0).alias("soh"),
        lenient_double("indent", 0.0).alias("indent"))


def clean_crt_size(crt: DataFrame) -> DataFrame:
    """crt size: key trimmed, Crt Size and No Crts lenient numbers with default 1."""
    return strip_text(crt).select(
        "material",
        lenient_double("crt_size", 1.0).alias("crt_size"),
        lenient_double("no_crts", 1.0).alias("no_crts"))
