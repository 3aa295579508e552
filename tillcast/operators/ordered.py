"""Ordered prefix counts without a global sort into one task.

``prefix_before`` gives, for every row, the total weight of the rows of its
key group that sort strictly before it. It is the building block of the
average-tie percent rank, exact medians, label codes, the positional split
and the day index of the daily series.

Plan: range-partition the rows on (keys, order) so that one hot key spreads
over many tasks; number rows inside each (partition, key) slice with a
window; sum the weight of each slice (a table of at most partitions x keys
rows); turn those sums into offsets with a window over the slices of a key;
add the offset back. No step holds a whole key group or the whole table in
one task, and nothing goes through the driver. The partitioned rows are
written once (with their partition id) to the shared checkpoint folder so the
two consumers of the partition id agree even if a task is re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.operators.joins import join_checked, with_scalars
from tillcast.operators.stage import step


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_before(df: DataFrame, order_cols: list[str], weight: str | None = None,
                  keys: list[str] | tuple = (), out: str = "_before",
                  partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``weight`` (1 per row if None) over the rows of the
    same ``keys`` whose ``order_cols`` sort strictly before this row's.

    Rows that tie on all ``order_cols`` are ordered arbitrarily among
    themselves; aggregate ties into one weighted row first when they must
    count together. There is one path, whatever the size of a key."""
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    n = _partitions(df, partitions)
    ranged = (df.repartitionByRange(n, *[F.col(c) for c in keys + list(order_cols)])
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_w", w.cast("long")))
    # The partition id is not a function of the row: materialise it once so
    # that the slice sums and the local numbering see the same assignment.
    ranged = step(ranged, "ranged")
    local_w = (Window.partitionBy("_pid", *keys).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, -1))
    ranged = ranged.withColumn("_local", F.coalesce(F.sum("_w").over(local_w), F.lit(0)))
    slices = ranged.groupBy("_pid", *keys).agg(F.sum("_w").alias("_slice"))
    # the table of slices has at most one row per partition and key
    off_w = (Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = slices.select(F.col("_pid").alias("_o_pid"), *[F.col(k).alias(f"_o_{k}") for k in keys],
                            F.coalesce(F.sum("_slice").over(off_w), F.lit(0)).alias("_off"))
    if not keys:
        offsets = F.broadcast(offsets)
    on = F.col("_pid") == F.col("_o_pid")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = ranged.join(offsets, on, "inner")
    return joined.withColumn(out, (F.col("_off") + F.col("_local")).cast("long")).drop(
        "_pid", "_w", "_local", "_off", "_o_pid", *[f"_o_{k}" for k in keys])


def exact_median(df: DataFrame, keys: list[str] | tuple, value: str, out: str,
                 partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact interpolated median of ``value`` per key group (NULLs skipped);
    ``weight`` counts how many rows each input row stands for.

    The value histogram (key, value, count) is built with map-side partial
    aggregation; prefix counts locate the one or two middle values, so a key
    holding a third of the rows spreads over tasks.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    hist = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("_c"))
    hist = prefix_before(hist, ["_v"], "_c", keys, "_b", partitions)
    n = hist.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if not keys:
        j = with_scalars(hist, n, ["_n"])
    else:
        j = hist.join(n, keys)
    return middle_values(j, keys, out)


def average_tie_pct_rank(df: DataFrame, value: str, out: str, weight: str | None = None,
                         keys: list[str] | tuple = (), partitions: int | None = None) -> DataFrame:
    """Distinct values of ``value`` with pandas ``rank(pct=True)`` (average ties).

    Returns (keys..., value, out). Join it back on the value. ``weight`` counts
    how many rows each input row stands for (e.g. a group's row count).
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(w.cast("long")).alias("_c"))
    hist = prefix_before(hist, [value], "_c", keys, "_b", partitions)
    tot = hist.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if not keys:
        j = with_scalars(hist, tot, ["_n"])
    else:
        j = hist.join(tot, keys)
    lo = F.col("_b") + 1
    hi = F.col("_b") + F.col("_c")
    return j.select(*keys, value, (((lo + hi) / 2.0) / F.col("_n")).alias(out))


def dense_codes(df: DataFrame, value: str, out: str, keys: list[str] | tuple = (),
                partitions: int | None = None) -> DataFrame:
    """0-based position of each distinct value in ascending (code-point) order.

    Equals scikit-learn's LabelEncoder on the same strings; a missing text is
    a class of its own, the last. Returns (keys..., value, out)."""
    keys = list(keys)
    rows = df.select(*keys, value).distinct().withColumn("_none", F.col(value).isNull().cast("int"))
    return prefix_before(rows, ["_none", value], None, keys, out, partitions).drop("_none")


def unpivot(df: DataFrame, specs: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """One scan of ``df``: for each row one row per spec, a tuple of columns under ``names``."""
    slots = [F.struct(*[c.alias(n) for c, n in zip(spec, names)]) for spec in specs]
    return df.select(F.explode(F.array(*slots)).alias("_s")).select(*[F.col(f"_s.{n}").alias(n) for n in names])


def exact_medians(df: DataFrame, specs: list[tuple[str, str | None, str]],
                  partitions: int | None = None, accuracy: int = 2000, small: int = 4096) -> DataFrame:
    """Several exact medians in one pass: ``specs`` is a list of
    (name, key column or None for the whole table, value column).
    Returns (_stat, _key, median) with the key as text ('' for the table).

    The medians of groups of at most ``small`` rows are taken from all values of the
    group at once, those of one key column together. Larger groups, of which there
    are few, in two passes: quantile summaries, merged map-side, give each group a bracket
    of two of its values that its median lies between (a summary errs by
    rows / ``accuracy`` ranks, the bracket leaves twice that on either side); then
    rows below the bracket are only counted and those within it make up the histogram
    in which the middle values are located. What is shuffled is bounded by
    groups x bracket, also where nearly every value is different."""
    rows, out = None, None
    for key in dict.fromkeys(key for _, key, _ in specs):
        of = [(name, value) for name, k, value in specs if k == key]
        f = df.select((F.col(key).cast("string") if key else F.lit("")).alias("_key"), *[F.col(v).cast("double").alias(f"_v{i}") for i, (_, v) in enumerate(of)])
        f = f.where(F.col("_key").isNotNull())
        if key:
            large = step(f.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small).select("_key"), "large-groups")
            whole = join_checked(f, large, "_key", "left_anti").groupBy("_key").agg(*[F.median(f"_v{i}").alias(f"_v{i}") for i in range(len(of))])
            whole = unpivot(whole, [(F.lit(n), F.col("_key"), F.col(f"_v{i}")) for i, (n, _) in enumerate(of)], ("_stat", "_key", "median")).where(F.col("median").isNotNull())
            out = whole if out is None else out.unionByName(whole)
            f = join_checked(f, large, "_key", "left_semi")
        f = unpivot(f, [(F.lit(n), F.col("_key"), F.col(f"_v{i}")) for i, (n, _) in enumerate(of)], ("_stat", "_key", "_val"))
        rows = f if rows is None else rows.unionByName(f)
    rows = rows.where(F.col("_val").isNotNull())
    keys, margin = ["_stat", "_key"], 2.0 / accuracy
    ends = F.percentile_approx("_val", [0.5 - margin, 0.5 + margin], accuracy)
    brackets = step(rows.groupBy(*keys).agg(ends.alias("_ends"), F.count(F.lit(1)).alias("_n"))
                     .select(*keys, F.col("_ends")[0].alias("_from"), F.col("_ends")[1].alias("_to"), "_n"), "median-brackets")
    near = join_checked(rows, brackets, keys, "inner").where("_val <= _to")
    # all that lies below the bracket is one value, before the others
    value = F.when(F.col("_val") >= F.col("_from"), F.col("_val"))
    hist = near.groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    found = middle_values(prefix_before(hist, ["_v"], "_c", keys, "_b", partitions), keys, "median")
    return found if out is None else found.unionByName(out)


def middle_values(hist: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Mean of the one or two middle values of each group, from rows (keys, _v
    value, _c its count, _b rows before it, _n rows of the group)."""
    k1, k2 = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def covers(k):
        return (F.col("_b") <= k) & (k < F.col("_b") + F.col("_c"))
    found = hist.where(covers(k1) | covers(k2)).groupBy(*keys).agg(
        F.max(F.when(covers(k1), F.col("_v"))).alias("_lo"), F.max(F.when(covers(k2), F.col("_v"))).alias("_hi"))
    return found.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(out))


def pct_ranks(parts: list[tuple[DataFrame, list[tuple[str, str, str | None]]]],
              partitions: int | None = None) -> DataFrame:
    """Several average-tie percent ranks in one pass: ``parts`` is a list of
    (frame, [(name, value column, weight column or None), ...]), each frame
    scanned once. Returns (_rk, _x, pct): join back on the value of rank ``_rk``."""
    u = None
    for f, specs in parts:
        rows = unpivot(f, [(F.lit(n), F.col(v).cast("double"), (F.col(w) if w else F.lit(1)).cast("long")) for n, v, w in specs],
                       ("_rk", "_x", "_wt"))
        u = rows if u is None else u.unionByName(rows)
    return average_tie_pct_rank(u, "_x", "pct", weight="_wt", keys=["_rk"], partitions=partitions)


def label_codes(df: DataFrame, specs: list[tuple[str, str]], partitions: int | None = None) -> DataFrame:
    """Several label encodings in one pass: ``specs`` is a list of
    (code name, text column). Returns (_cn, _val, code); a missing text has a
    code of its own, after those of the texts."""
    rows = unpivot(df, [(F.lit(n), F.col(c).cast("string")) for n, c in specs], ("_cn", "_val"))
    return dense_codes(rows, "_val", "code", ["_cn"], partitions)
