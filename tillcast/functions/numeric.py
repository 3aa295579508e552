"""Numeric Column helpers that keep work inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significant digits of every reported double: far inside double precision, so
# the last-bit noise of sums in a different order cannot show, and the same
# share of a small value as of a large one.
REPORT_DIGITS = 9


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r4(c) -> Column:
    """Report rounding of a double: REPORT_DIGITS significant digits (zero unsigned)."""
    x = col_(c).cast("double")
    scale = F.pow(F.lit(10.0), REPORT_DIGITS - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale, 0) / scale)


def money(c) -> Column:
    """A total of two-decimal money as text, to the cent."""
    return col_(c).cast("decimal(38,2)").cast("string")


def nan_to_null(c) -> Column:
    """pandas skips NaN in aggregates, Spark does not: turn NaN into NULL."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# What counts as a number in a text cell (a fixed pattern).
NUMBER = r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def lenient_double(c, default: float) -> Column:
    """Text or number to double; unparsable, blank, NaN or missing -> default.

    The text is checked first: the JVM's own parser would take '12d' or '0x1p3'."""
    text = F.trim(col_(_name(c)).cast("string"))
    parsed = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.coalesce(nan_to_null(parsed), F.lit(float(default)))


def _name(c) -> str:
    if isinstance(c, str):
        return c
    raise TypeError("lenient_double takes a column name")


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 (ANSI mode would raise)."""
    return F.try_divide(col_(a), col_(b))


def log1p_(c) -> Column:
    """ln(1+x); NULL for x <= -1 (numpy gives -inf or NaN there)."""
    c = col_(c)
    return F.when(c > -1, F.log1p(c))


def safe_qty(c) -> Column:
    """Divisor rule of the price: 0 and NULL become 1."""
    c = col_(c)
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))


def finite_or_zero(c) -> Column:
    """Matrix sanitising: NULL, NaN and +-inf become 0."""
    c = col_(c).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def row_mean_skip_null(cols: list) -> Column:
    """Mean across columns skipping NULLs; NULL when all are NULL.

    Plain arithmetic (no per-row array) so it stays in generated code."""
    xs = [col_(c).cast("double") for c in cols]
    total = F.lit(0.0)
    n = F.lit(0)
    for x in xs:
        total = total + F.coalesce(x, F.lit(0.0))
        n = n + x.isNotNull().cast("int")
    return F.when(n > 0, total / n)
