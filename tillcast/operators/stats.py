"""Grouped statistics joined back to the rows.

Every statistic is a ``groupBy().agg()`` (map-side partial aggregation, so a
hot key is combined before the shuffle) followed by a join back on the key;
no ``Window.partitionBy(key)`` over the fact. Money is summed as DECIMAL so
sums are exact and independent of task order; means are the exact sum
divided by the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.operators.ordered import exact_median


def exact_mean(value: str) -> Column:
    """Mean of a DECIMAL column as double: exact sum / count."""
    return F.sum(F.col(value)).cast("double") / F.count(F.col(value))


def exact_sum(value: str) -> Column:
    """Sum of a DECIMAL column as double, 0 when the group has no value."""
    return F.coalesce(F.sum(F.col(value)).cast("double"), F.lit(0.0))


# Statistics a group table can carry, by suffix (fixed names of the reference).
def group_stats(df: DataFrame, key: str | list[str], prefix: str, value: str, qty: str, price: str,
                stats: tuple[str, ...] = ("AvgSale", "MedSale", "MaxSale", "SumSale",
                                          "AvgQty", "AvgPrice", "Count"),
                extra: list[Column] | None = None,
                medians: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per-key statistics named ``{prefix}_{stat}``.

    AvgSale, MedSale, MaxSale, MinSale, StdSale, SumSale, Count of the value;
    AvgQty of the quantity; AvgPrice, MedPrice of the price. Rows whose key is
    NULL are left out (pandas drops them from groups). Medians are exact and
    computed from value histograms (see :func:`exact_median`).
    """
    keys = [key] if isinstance(key, str) else list(key)
    g = df
    for k in keys:
        g = g.where(F.col(k).isNotNull())
    aggs = {
        "AvgSale": exact_mean(value),
        "MaxSale": F.max(value).cast("double"),
        "MinSale": F.min(value).cast("double"),
        "StdSale": F.coalesce(F.stddev_samp(F.col(value).cast("double")), F.lit(0.0)),
        "SumSale": exact_sum(value),
        "Count": F.count(value),
        "AvgQty": F.avg(qty),
        "AvgPrice": F.avg(price),
    }
    cols = [aggs[s].alias(f"{prefix}_{s}") for s in stats if s in aggs]
    cols.append(F.count(F.lit(1)).alias(f"_{prefix}_rows"))
    cols.extend(extra or [])
    out = g.groupBy(*keys).agg(*cols)
    medians = medians or {}
    for stat, col in (("MedSale", value), ("MedPrice", price)):
        if stat in stats:
            name = f"{prefix}_{stat}"
            med = medians.get(name)
            if med is None:
                med = exact_median(g, keys, col, name)
            out = out.join(med, keys, "left")
    return out


def leave_one_out(total: Column, count: Column, own: Column) -> Column:
    """(group sum - own value) / (group count - 1 + 1e-9)."""
    return (total - own) / (count - 1 + F.lit(1e-9))


def smooth_encode(count: Column, mean: Column, prior: Column, alpha: float) -> Column:
    """(n * mean + alpha * prior) / (n + alpha)."""
    return (count * mean + F.lit(float(alpha)) * prior) / (count + F.lit(float(alpha)))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + 1e-9)."""
    return (x - mean) / (std + F.lit(1e-9))


def minmax_norm(x: Column, lo: Column, hi: Column) -> Column:
    """(x - min) / (max - min + 1)."""
    return (x - lo) / (hi - lo + 1)
