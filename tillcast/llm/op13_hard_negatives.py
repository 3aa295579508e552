"""Operator 13: hard negatives by an inverted multi-index.

Vectors are halved, and either half has a codebook, learnt by k-means from a
sample of ``max_sample`` vectors; a cell is a pair of codewords. A half's inner product with
the anchor's half is at most that of its codeword plus the anchor's length
times the codeword's radius (the largest distance of a member), so the sum of both bounds a
cell's scores. For an anchor, a heap visits cells in descending order of that sum
(multi-sequence), and stops once the next bound is below what it needs.

Each of the two searches, for positives and for negatives, visits twice: first
the best cells up to ``seed_rows`` vectors, which gives a score that the answer can't fall
below, then every other cell whose bound reaches it. What is found is so certified,
not estimated. For negatives of a window [low, high] of scores, cells whose
scores all lie above each window are passed over.

Vectors are grouped by (vector, label) first and kept with their smallest ids, ``keep`` of them:
no list is longer, and equal scores go by id, so no other can be in an answer. A
cell is dealt to blocks of ``BLOCK`` vectors, anchors to groups of ``ANCHORS``; a
task compares the anchors of a group that visit a block with it by a matrix product,
and sends on each anchor's best. Codebooks, radii and cell sizes are at most
``most_codes`` squared rows.

Edge cases: rows without label, vector or id, or with a null, NaN or infinite
component take no part; a row is compared with rows of its dimension only; rows
that are repeated count once, other rows of one id each (an anchor is not compared with rows of
its id; of several it is the one whose vector and label come first); components of
which a score might not fit 63 bits are an error; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import first_columns, release, stage, table

BLOCK, ANCHORS = 2048, 1024
EXACT = float(1 << 53)


def codebook(sample: np.ndarray, codes: int, seed: int, steps: int = 15) -> np.ndarray:
    """k-means: at most ``codes`` codewords."""
    different = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    words = different[rng.permutation(len(different))[:codes]]
    for _ in range(steps):
        of = nearest(sample, words)
        total = np.zeros_like(words)
        np.add.at(total, of, sample)
        n = np.bincount(of, minlength=len(words))[:, None]
        words = np.where(n > 0, total / np.maximum(n, 1), words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(1) - 2 * (x @ words.T)).argmin(1)


def cells_in_order(a: np.ndarray, b: np.ndarray):
    """Pairs (i, j) by descending a[i] + b[j], with the sum: multi-sequence over both sorted lists."""
    p, q = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    x, y = a[p].tolist(), b[q].tolist()
    heap, seen = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, int(p[i]), int(q[j])
        for i, j in ((i + 1, j), (i, j + 1)):
            if i < len(x) and j < len(y) and (i, j) not in seen:
                seen.add((i, j))
                heapq.heappush(heap, (-(x[i] + y[j]), i, j))


class Index:
    """Codewords of both halves, their radii, and how many vectors each cell holds."""

    def __init__(self, half: int, words, radii, sizes: dict):
        self.half, self.words, self.radii, self.sizes = half, words, radii, sizes

    def bounds(self, vector: np.ndarray):
        """Per half and codeword (largest, smallest) score of its members, a little widened for rounding."""
        out = []
        for part, words, radii in zip((vector[:self.half], vector[self.half:]), self.words, self.radii):
            at, away = words @ part, math.sqrt(float(part @ part)) * radii
            slack = 1e-9 * (np.abs(at) + away) + 1e-6
            out.append((at + away + slack, at - away - slack))
        return out

    def visits(self, vector: np.ndarray, floor: float, ceiling: float = math.inf, seed_rows: int = 0, skip: int = 0):
        """Cells for an anchor in descending order of their bounds: with
        ``seed_rows``, the first ones up to so many vectors; else all whose bound
        reaches ``floor`` but the first ``skip`` ones. Cells whose scores all lie above ``ceiling`` are left out."""
        (high1, low1), (high2, low2) = self.bounds(vector)
        rows = number = 0
        for bound, i, j in cells_in_order(high1, high2):
            if bound < floor or seed_rows and rows >= seed_rows:
                return
            size = self.sizes.get((i, j))
            if size and low1[i] + low2[j] <= ceiling:
                number += 1
                rows += size
                if number > skip:
                    yield i, j


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """Rows (x: whole numbers, label, id), each different one once."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(math.inf)))
    rows = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    return rows.select(F.transform("vector", lambda v: F.floor(v.cast("double") * scale)).alias("x"), "label", "id").distinct()


def smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """Rows (x, label, ids: the ``keep`` smallest); each task drops the others before the shuffle."""
    w = Window.partitionBy("x", "label").orderBy("id")
    first = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return first.groupBy("x", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def learn(rows: DataFrame, n: int, dimension: int, max_sample: int, most_codes: int) -> tuple[int, list[np.ndarray]]:
    half = max(1, dimension // 2)
    sample = np.array([r.x for r in rows.select("x").orderBy(F.xxhash64("x"), "x").limit(max_sample).collect()], float).reshape(-1, dimension)
    codes = max(1, min(most_codes, round(math.sqrt(n / (BLOCK / 2)))))
    return half, [codebook(sample[:, :half], codes, 1), codebook(sample[:, half:], codes, 2)]


def placed(rows: DataFrame, half: int, words, columns: str) -> DataFrame:
    """``rows`` with cell (i, j) and the distances from both codewords."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            cols = []
            for part, book in zip((x[:, :half], x[:, half:]), sent.value):
                of = nearest(part.astype(float), book)
                cols.append((of, np.sqrt(((part - book[of]) ** 2).sum(1)) * (1 + 1e-9)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0][0], pa.int32()), pa.array(cols[1][0], pa.int32()), pa.array(cols[0][1]), pa.array(cols[1][1])],
                                             names=[*batch.schema.names, "i", "j", "d1", "d2"])
    return rows.mapInArrow(run, f"{columns}, i int, j int, d1 double, d2 double")


def matrix(column) -> np.ndarray:
    """A list column of one length as a matrix of whole numbers."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products; in floating point where it is exact."""
    top = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if top < EXACT else a @ b.T


def compared(asks: DataFrame, blocks: DataFrame, n_groups: int, k: int, others: bool) -> DataFrame:
    """From asks (anchor, label, x, low, high, i, j) and blocks (i, j, block, x, label, ids): the k
    best of each window low <= score <= high within each block as (anchor, window, id, score),
    of rows of the anchor's label but itself, or with ``others`` of other labels."""
    def run(left, right):
        import pyarrow as pa
        none = pa.table({"anchor": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        score = products(matrix(left.column("x")), matrix(right.column("x")))
        anchors, labels = left.column("anchor").to_numpy(), left.column("label").to_numpy()
        of = right.column("ids").combine_chunks()
        times, ids = np.diff(of.offsets.to_numpy()), of.flatten().to_numpy()
        row = np.repeat(np.arange(right.num_rows), times)
        label = right.column("label").to_numpy()[row]
        lows, highs = (left.column(c).to_pylist() for c in ("low", "high"))
        out = []
        for r, (anchor, own) in enumerate(zip(anchors, labels)):
            s = score[r][row]
            fit = label != own if others else (label == own) & (ids != anchor)
            at = np.flatnonzero(fit & (s >= min(lows[r])) & (s <= max(highs[r])))
            at = at[np.lexsort((ids[at], -s[at]))]
            falling = -s[at]
            for w, (low, high) in enumerate(zip(lows[r], highs[r])):
                if low <= high:
                    begin = int(np.searchsorted(falling, -high, "left"))
                    stop = min(begin + k, int(np.searchsorted(falling, -low, "right")))
                    if begin < stop:
                        part = at[begin:stop]
                        out.append((np.full(len(part), anchor), np.full(len(part), w), ids[part], s[part]))
        if not out:
            return none
        a, w, i, s = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(a), pa.array(w, pa.int32()), pa.array(i), pa.array(s)], names=["anchor", "window", "id", "score"])
    group = F.pmod(F.xxhash64("anchor"), F.lit(n_groups)).cast("int")
    wanted = blocks.select(F.col("i"), F.col("j"), "block").distinct()
    left = asks.join(wanted, ["i", "j"]).select(group.alias("ag"), F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("block").alias("ab"), "anchor", "label", "x", "low", "high")
    right = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))) if n_groups > 1 else blocks.withColumn("g", F.lit(0))
    return left.groupBy("ag", "ai", "aj", "ab").cogroup(right.groupBy("g", "i", "j", "block")).applyInArrow(run, "anchor long, window int, id long, score long")


def asked(anchors: DataFrame, index, seed_rows: int, seeds: bool) -> DataFrame:
    """One row for each cell that an anchor (anchor, label, x, low, high) visits: the
    first cells (``seeds``), or those after them whose bound reaches the lowest window."""
    def run(batches):
        import pyarrow as pa
        ix = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cells = [], []
            for r, (vector, lows, highs) in enumerate(zip(matrix(batch.column("x")).astype(float), batch.column("low").to_pylist(), batch.column("high").to_pylist())):
                open_ = [(a, b) for a, b in zip(lows, highs) if a <= b]
                if open_:
                    ceiling = max(b for _, b in open_)
                    found = list(ix.visits(vector, -math.inf, ceiling, seed_rows=seed_rows))
                    if not seeds:
                        found = list(ix.visits(vector, min(a for a, _ in open_), ceiling, skip=len(found)))
                    rows += [r] * len(found)
                    cells += found
            i, j = zip(*cells) if cells else ((), ())
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["anchor", "label", "x", "low", "high", "i", "j"])
    return anchors.select("anchor", "label", "x", "low", "high").mapInArrow(run, "anchor long, label long, x array<long>, low array<long>, high array<long>, i int, j int")


def top(found: DataFrame, k: int) -> DataFrame:
    """Ranks (anchor, window, rank from 1, id, score) of the k best of each window; blocks sent k each at most."""
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def searched(anchors: DataFrame, blocks: DataFrame, index, n_groups: int, k: int, seed_rows: int, others: bool) -> DataFrame:
    """The k best of each anchor and window (anchor, window, rank, id, score), certified by two visits."""
    first = stage(top(compared(asked(anchors, index, seed_rows, True), blocks, n_groups, k, others), k), "negatives-seeds")
    full = first.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    # a window that has its k needs what reaches the last of them, another one all down to its low end
    need = anchors.select("anchor", F.posexplode("low").alias("window", "bottom")).join(full, ["anchor", "window"], "left")
    need = need.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", F.coalesce("least", "bottom").alias("low")))).alias("need"))
    again = anchors.join(need, "anchor").withColumn("low", F.col("need.low"))
    rest = compared(asked(again, index, seed_rows, False), blocks, n_groups, k, others)
    out = stage(top(first.select("anchor", "window", "id", "score").unionAll(rest), k), "negatives-found")
    release(first)
    return out


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None,
         max_sample: int = 10_000, most_codes: int = 128, seed_rows: int = 4096) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor (``is_anchor`` over the column ``id``) and each of its first ``positives`` other rows of its label, the
    first ``negatives`` rows of other labels that score ``low`` to ``high`` hundredths of the
    positive's score. ``label`` may replace labels by an expression of ``id`` and ``label``."""
    spark = vectors.sparkSession
    vectors = first_columns(vectors, id=id_col, vector=vector_col, label=label_col)
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "vector", F.col("label").cast("long").alias("label"))
    if label is not None:
        vectors = vectors.withColumn("label", label.cast("long"))
    rows = stage(smallest_ids(usable(vectors, scale), max(positives + 1, negatives)), "negatives-vectors")
    anchors = usable(vectors.where(is_anchor), scale).groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("x", "label")).alias("_a"))
    anchors = stage(anchors.select("anchor", F.col("_a.label").alias("label"), F.col("_a.x").alias("x")), "negatives-anchors")
    out = None
    dimensions = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).orderBy("d").collect()  # one row a dimension
    for d, n, most in dimensions:
        if not d:
            continue
        if d * float(most) ** 2 >= float(1 << 63):
            raise ValueError("components too large for scores of 63 bits")
        mined = mine_dimension(spark, rows.where(F.size("x") == d), anchors.where(F.size("x") == d), n, d, positives, negatives, low, high, max_sample, most_codes, seed_rows)
        out = mined if out is None else out.unionAll(mined)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], schema) if out is None else out


def mine_dimension(spark, rows, anchors, n, dimension, positives, negatives, low, high, max_sample, most_codes, seed_rows) -> DataFrame:
    half, words = learn(rows, n, dimension, max_sample, most_codes)
    cells = stage(placed(rows.select("x", "label", "ids"), half, words, "x array<long>, label long, ids array<long>"), "negatives-cells")
    sizes = {(r.i, r.j): r.n for r in cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect()}  # most_codes ** 2 rows at most
    radii = []
    for c, at, book in (("i", "d1", words[0]), ("j", "d2", words[1])):
        far = {r[0]: r[1] for r in cells.groupBy(c).agg(F.max(at)).collect()}  # most_codes rows at most
        radii.append(np.array([far.get(k, 0.0) for k in range(len(book))]))
    index = spark.sparkContext.broadcast(Index(half, words, radii, sizes))
    # cells of many vectors are dealt to several blocks
    most = max(sizes.values())
    parts = F.lit(0) if most <= BLOCK else F.pmod(F.xxhash64("x", "label"), F.ceil(F.col("n") / BLOCK)).cast("int")
    counted = cells.join(F.broadcast(spark.createDataFrame([(i, j, s) for (i, j), s in sizes.items()], "i int, j int, n long")), ["i", "j"])
    blocks = stage(counted.select("i", "j", parts.alias("block"), "x", "label", "ids"), "negatives-blocks")
    n_groups = max(1, math.ceil(anchors.count() / ANCHORS))
    most = F.array(F.lit((1 << 63) - 1))
    whole = anchors.select("anchor", "label", "x", F.transform(most, lambda v: -v).alias("low"), most.alias("high"))
    near = searched(whole, blocks, index, n_groups, positives, seed_rows, False)
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("near"))  # ``positives`` at most
    share = lambda p, part: p["score"].cast("decimal(20,0)") * F.lit(part).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    edges = anchors.join(windows, "anchor").select(
        "anchor", "label", "x", F.transform("near", lambda p: F.ceil(share(p, low)).cast("long")).alias("low"), F.transform("near", lambda p: F.floor(share(p, high)).cast("long")).alias("high"))
    found = searched(edges, blocks, index, n_groups, negatives, seed_rows, True)
    pairs = near.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window"))
    got = found.select(F.col("anchor").alias("anchor_id"), "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(got, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


ORACLE_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 10
"""
