"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.operators.stage import release, stage

__all__ = ["chunks", "compared", "components", "first_columns", "free_name", "in_blocks", "local_components", "mixed", "number_within",
           "release", "stage", "table", "whole_groups", "word_hashes"]

#: ASCII white space: \x20 and \x09 to \x0D. Everything else belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_columns(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the given new names: nothing else that a
    table carries can clash with the operators' own columns."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str, n_rows: int,
                  rows_per_block: int = 4000) -> DataFrame:
    """Adds ``name``: a gapless number from 0 for each row among the rows of
    equal ``keys`` (which hold no null).

    A key may hold any share of the rows: they are numbered in blocks by hash,
    and each block starts where the counts of the blocks before it end. Only
    the table of block counts is summed in order. ``df`` must be a written table."""
    blocks = max(1, math.ceil(n_rows / rows_per_block))
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    starts = (df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_n")).drop("_n"))
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (df.withColumn("_at", F.row_number().over(w) - 1).join(starts, [*keys, "_block"])
            .withColumn(name, (F.col("_at") + F.col("_start")).cast("long")).drop("_at", "_start", "_block"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the edges (a, b): rows (id, component), where
    component is the smallest id reachable. Ids without an edge are absent.

    Alternates large-star and small-star steps (min of the neighbourhood by a
    grouped minimum, joined back), each round written to the shared folder. A
    hub with very many edges is one grouped minimum and a join AQE can split."""
    a, b = F.col("a"), F.col("b")
    now = stage(edges.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}-edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        files = math.ceil(mark[0] / 200_000)  # edges never become more
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        old, now = now, stage(small.coalesce(files), f"{name}-round")
        release(old)
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def in_blocks(df: DataFrame, key: str, row: Column, block: int, weight: Column | None = None) -> DataFrame:
    """Deals the rows of each key that has two or more to groups ``_g`` of about
    2 x ``block`` rows (or sums of ``weight``) at most, so that any two rows of a key meet in exactly one group.

    A key with more than ``block`` is cut into k chunks by a hash of
    ``row``, and each pair of chunks is a group (``_i`` <= ``_j``; ``_c`` is
    the row's own chunk): in group (i, i) compare all rows, in (i, j) only rows
    of different chunks."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.lit(1) if weight is None else weight).alias("_w")).where("_n > 1")
    df = (df.join(n, key).withColumn("_k", F.ceil(F.col("_w") / block).cast("int"))
          .withColumn("_c", F.pmod(F.xxhash64(row), F.col("_k")).cast("int")).drop("_n", "_w"))
    one = df.where("_k = 1").withColumns({"_i": F.lit(0), "_j": F.lit(0)})
    c = F.col("_c")
    many = (df.where("_k > 1").withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
            .withColumns({"_i": F.least(c, F.col("_x")), "_j": F.greatest(c, F.col("_x"))}).drop("_x"))
    return one.unionByName(many).withColumn("_g", F.xxhash64(key, "_i", "_j")).drop("_k")


def whole_groups(batches, key: str = "_g"):
    """From record batches sorted by ``key``: tables that hold whole groups."""
    import pyarrow as pa
    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(g, g[-1], "left"))
        if last or rest and rest[-1].column(key)[-1].as_py() != g[0]:
            split = last
            if rest and not split:
                yield pa.Table.from_batches(rest)
                rest = [batch]
                continue
            yield pa.Table.from_batches([*rest, batch.slice(0, split)])
            rest = [batch.slice(split)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a, b)."""
    lab = np.arange(n)
    while len(a):
        # the larger root of each edge hooks onto the smallest root it meets; then all point at roots again
        np.minimum.at(lab, np.maximum(lab[a], lab[b]), np.minimum(lab[a], lab[b]))
        while (lab[lab] != lab).any():
            lab = lab[lab]
        keep = lab[a] != lab[b]
        a, b = a[keep], b[keep]
    return lab


def compared(rows: DataFrame, most: int) -> DataFrame:
    """From rows (node, id, b0, b1): edges (a, b) of a spanning forest over the
    rows of each node whose sketches of 128 bits differ in ``most`` at most. Nodes are small."""
    def run(batches):
        import pyarrow as pa
        for t in whole_groups(batches, "node"):
            node, ids = t.column("node").to_numpy(), t.column("id").to_numpy()
            b0, b1 = (t.column(c).to_numpy().view(np.uint64) for c in ("b0", "b1"))
            left, right, step, alive = [], [], 1, np.arange(len(node))
            while True:
                alive = alive[alive + step < len(node)]
                alive = alive[node[alive] == node[alive + step]]
                if not len(alive):
                    break
                other = alive + step
                near = np.bitwise_count(b0[alive] ^ b0[other]).astype(int) + np.bitwise_count(b1[alive] ^ b1[other]) <= most
                left.append(alive[near])
                right.append(other[near])
                step += 1
            if left:
                lab = local_components(len(node), np.concatenate(left), np.concatenate(right))
                at = np.flatnonzero(lab != np.arange(len(lab)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[lab[at]])], names=["a", "b"])
    return rows.select("node", "id", "b0", "b1").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty span of bytes; spans follow each other and ``data`` holds only their bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(starts, lengths)
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return mixed(np.add.reduceat(letters[data] * powers(int(lengths.max()))[at], starts) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE):
    """Words of documents that lie one after another in ``data`` (uint8), the
    i-th ending before ``ends[i]``: (hash, document, first byte, length) per word."""
    inside = ~space[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = ends[:-1]
    before[firsts[firsts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    number = np.cumsum(inside)  # of word bytes up to here
    begin = number[starts] - 1
    lengths = np.diff(np.append(begin, number[-1]))
    return span_hashes(data[inside], begin, lengths), np.searchsorted(ends, starts, "right"), starts, lengths


def chunks(column, size: int = 1 << 20):
    """Cuts an Arrow string column into runs of whole documents of about
    ``size`` bytes: (first row, bytes, ends of the documents). A null is empty."""
    import pyarrow as pa
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, data[at[row]:at[stop]], at[row + 1:stop + 1] - at[row]
        row = stop
