"""Operator 10: embedding near-duplicates by iterative quantisation.

Iterative quantisation learns, from a sample of ``max_sample`` vectors (the
first by hash), a rotation of the centred vectors' principal axes that brings
them closest to the corners of a cube; the signs of the rotated vector are a
balanced binary code. Several rotations, from different starts, give several
codes. Their bits are cut into substrings of about log2(number of vectors)
bits, each the key of a Hamming table: the multi-index. Tables are added until
pairs made at the threshold from the sample's vectors meet in one of them as
often as ``recall`` asks. Where vectors share a common part, centring takes such
pairs further apart and more tables are needed; where so many are needed that
comparing all vectors in blocks is less work, that is done. All vectors are in all tables.

Vectors that meet in a bucket and whose first codes are close are candidates;
a bucket of more than ``leaf`` is a candidate whole. Components of candidates
are then compared with the original vectors in double precision, all pairs in
blocks of bounded size, so links are exact and no pair is emitted.

Edge cases: a vector that is null, zero, or holds null or non-finite components
links with nothing; vectors of different dimensions are never linked, each
dimension is searched by itself; equal vectors enter as one with their count; repeated rows are vectors of their own; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import compared, components, first_columns, in_blocks, local_components, release, stage, table, whole_groups

SKETCH = 128  # bits of a candidate test: the first two codes


def rotations(centred: np.ndarray, bits: int, seed: int = 0, steps: int = 30):
    """Projections of d x bits without end, by alternating between the codes of the
    rotated sample and the rotation that best maps it to them."""
    axes = np.linalg.svd(centred, full_matrices=len(centred) < centred.shape[1])[2][:bits].T
    reduced = centred @ axes
    rng = np.random.default_rng(seed)
    while True:
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
        for _ in range(steps):
            corners = np.where(reduced @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(corners.T @ reduced)
            turn = (u @ vt).T
        yield axes @ turn


def learn_rotations(sample: np.ndarray, codes: int, bits: int, seed: int = 0, steps: int = 30) -> tuple[np.ndarray, list[np.ndarray]]:
    """(mean, that many projections)."""
    mean = sample.mean(0)
    return mean, list(islice(rotations(sample - mean, bits, seed, steps), codes))


def tables_needed(n: int, threshold: float, recall: float, dimension: int) -> tuple[int, int]:
    """(bits of a substring, number of tables): a bit of a pair at the
    threshold differs with probability angle / pi."""
    bits = max(4, min(round(math.log2(max(n, 2))), dimension, 32))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def threshold_pairs(sample: np.ndarray, threshold: float, pairs: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two sets of pairs of unit vectors at cosine ``threshold``: a sample's
    vector turned towards any direction, and along the difference of two others."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(np.resize(np.arange(len(sample)), pairs))]
    a, b = (sample[rng.integers(len(sample), size=pairs)] for _ in range(2))
    out = []
    for turn in (rng.normal(size=x.shape), a - b):
        turn = turn - (turn * x).sum(1, keepdims=True) * x
        size = np.sqrt((turn * turn).sum(1))
        fine = size > 1e-9
        if fine.any():
            out.append((x[fine], threshold * x[fine] + math.sqrt(1 - threshold ** 2) * turn[fine] / size[fine, None]))
    return out


def multi_index(sample: np.ndarray, n: int, threshold: float, recall: float, enough: int, seed: int = 0, pairs: int = 4096):
    """(bits of a substring, substrings of a code, number of tables or None,
    sketch distance, (mean, projections)) for ``n`` vectors: as many tables as
    pairs at the threshold need to meet, one standard error on the safe side;
    None where that is more than ``enough``, or than twice what vectors without a common part need."""
    dimension = sample.shape[1]
    width = min(64, dimension)
    bits, least = tables_needed(n, threshold, recall, dimension)
    each = max(1, width // bits)
    made = threshold_pairs(sample, threshold, pairs, seed)
    apart = [np.ones(len(x), bool) for x, _ in made]
    distance = [np.zeros(len(x), int) for x, _ in made]
    allowed = max(0.0, (1 - recall) - math.sqrt((1 - recall) / pairs))
    mean, projections, tables = sample.mean(0), [], 0
    for projection in rotations(sample - mean, width, seed):
        projections.append(projection)
        differ = [((x - mean) @ projection >= 0) != ((y - mean) @ projection >= 0) for x, y in made]
        if len(projections) <= 2:
            distance = [d + one.sum(1) for d, one in zip(distance, differ)]
        for part in range(each):
            if tables >= least and all(one.mean() <= allowed for one in apart):
                break
            apart = [one & d[:, part * bits:(part + 1) * bits].any(1) for one, d in zip(apart, differ)]
            tables += 1
        done = tables >= least and all(one.mean() <= allowed for one in apart)
        if not done and tables >= max(enough, 2 * least):
            return bits, each, None, 0, (mean, projections)
        if done and len(projections) > 1:
            return bits, each, tables, int(max((d.max() for d in distance), default=0)), (mean, projections)


def usable():
    """Whether the column ``v`` holds a vector that can link."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0), F.lit(False))


def unit(flat: np.ndarray, dimension: int) -> np.ndarray:
    x = flat.reshape(-1, dimension)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def coded(vectors: DataFrame, model, dimension: int) -> DataFrame:
    """Adds ``codes``, one long for each rotation, to rows (id, v)."""
    def run(batches):
        import pyarrow as pa
        mean, projections = model.value
        for batch in batches:
            x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False), dimension) - mean
            codes = np.zeros((len(x), len(projections)), np.uint64)
            for i, p in enumerate(projections):
                signs = (x @ p >= 0).astype(np.uint64)
                codes[:, i] = (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(projections)), pa.array(codes.view(np.int64).ravel()))], names=["id", "codes"])
    return vectors.select("id", "v").mapInArrow(run, "id long, codes array<long>")


def checked(rows: DataFrame, dimension: int, threshold: float) -> DataFrame:
    """For each vector of each block (see in_blocks): (id, links, root), as in the Jaccard join."""
    def run(batches):
        import pyarrow as pa
        for t in whole_groups(batches):
            g = t.column("_g").to_numpy()
            cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(g))):
                part = t.slice(a, b - a).combine_chunks()
                ids, n, chunk = (part.column(c).to_numpy() for c in ("id", "n_vectors", "_c"))
                x = unit(part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), dimension)
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if part.column("_i")[0].as_py() != part.column("_j")[0].as_py():
                    near &= chunk[:, None] != chunk[None, :]
                left, right = np.nonzero(np.triu(near))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ n), pa.array(ids[local_components(len(ids), left, right)])], names=["id", "links", "root"])
    return rows.select("_g", "_i", "_j", "_c", "id", "n_vectors", "v").repartition("_g").sortWithinPartitions("_g").mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.995,
                    max_sample: int = 10000, leaf: int = 256, block: int = 1024, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    rows = first_columns(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>")).withColumn("ok", usable())
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    every = stage(rows.select("vec_id", "ok", *keys), "embeddings-rows")
    # each different vector once, under a number that is given at this writing
    distinct = rows.where("ok").select("vec_id", "v", *keys).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n_vectors"), F.first("v").alias("v"))
    distinct = stage(distinct.withColumn("id", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "embeddings-vectors")
    result = distinct.where("false").select("k1", "k2", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    for d, n in sorted(map(tuple, distinct.groupBy("d").count().collect())):  # one row a dimension
        own = distinct.where(F.col("d") == d)
        result = result.unionAll(linked(own, n, d, threshold, recall, max_sample, leaf, block, seed) if n > 1 else own.select("k1", "k2", F.col("n_vectors") - 1, "rep"))
    # what cannot link takes no part in the join, so that many nulls meet in no task
    out = every.where("ok").join(result, ["k1", "k2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return out.unionAll(every.where("not ok").select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))


def linked(distinct: DataFrame, n: int, dimension: int, threshold: float, recall: float, max_sample: int, leaf: int, block: int, seed: int) -> DataFrame:
    """(k1, k2, n_links, component_id) of the ``n`` different vectors of one dimension, rows (id, k1, k2, rep, n_vectors, v)."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64("k1", F.lit(seed)), "k1", "k2").limit(max_sample).select("v").toArrow()
    sample = unit(sample.column(0).combine_chunks().flatten().to_numpy(), dimension)
    # a table sends on a few numbers of each vector, a block the vector
    bits, each, tables, most, model = multi_index(sample, n, threshold, recall, 8 * n // block, seed)
    if tables is None:
        near = stage(distinct.select("id", F.lit(0).cast("long").alias("component")), "embeddings-members")
    else:
        model = spark.sparkContext.broadcast(model)
        codes = stage(coded(distinct, model, dimension), "embeddings-codes")
        node = F.expr(f"transform(sequence(0, {tables - 1}), t -> xxhash64(t, shiftrightunsigned(codes[cast(t div {each} as int)], t % {each} * {bits}) & {(1 << bits) - 1}L))")
        buckets = codes.select("id", F.col("codes")[0].alias("b0"), F.col("codes")[1].alias("b1"), F.explode(node).alias("node"))
        counts = buckets.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low")).where("size > 1")
        buckets = stage(buckets.join(counts, "node"), "embeddings-buckets")
        edges = compared(buckets.where(F.col("size") <= leaf), most).unionAll(
            buckets.where((F.col("size") > leaf) & (F.col("id") != F.col("low"))).select(F.col("id").alias("a"), F.col("low").alias("b")))
        near = stage(components(edges, "embeddings-candidates"), "embeddings-members")
        release(codes, buckets)
    members = in_blocks(near.join(distinct.select("id", "n_vectors"), "id"), "component", F.col("id"), block)
    found = stage(checked(members.join(distinct.select("id", "v"), "id"), dimension, threshold), "embeddings-links")
    groups = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "embeddings-components")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = distinct.select("id", "k1", "k2", "rep", "n_vectors").join(groups, "id", "left").join(links, "id", "left").withColumn("component", F.coalesce("component", "id"))
    result = stage(result, "embeddings-result")
    release(near, found)
    leads = result.groupBy("component").agg(F.min("rep").alias("component_id"))
    return result.join(leads, "component").select("k1", "k2", (F.col("n_vectors") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE vec AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
link AS (SELECT a AS vec_id, count(*) AS n FROM pair GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c USING (vec_id) LEFT JOIN link l USING (vec_id)
"""
