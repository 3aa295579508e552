"""Operator 7: n-gram Jaccard join by chosen paths.

Every different text is a set of shingles of ``shingle`` words, with a signature
of COORDINATES min-hashes. A run starts with all sets in one bucket and splits
it recursively: a bucket draws 1 / threshold coordinates on average, and every
set goes on to one bucket for each drawn coordinate, that of its value there,
that is of a sampled token it shares with the others. A pair at the threshold is
expected once in the children of its bucket. After ``first`` splits, buckets of
at most ``leaf`` sets are compared by brute force on one-bit sketches and larger
ones split on; runs are repeated until a pair at the threshold is met with
probability ``recall`` even at the last ``depth``. A bucket that is still larger
there is taken as one candidate whole.

Candidates are connected into components; then all pairs of each component are
checked exactly on the shingles of the whole texts, in blocks of bounded size
that Spark deals out, so every link is found once and none is emitted as a pair:
a block returns for each of its texts the number of documents linked and one
edge of a spanning forest.

A text of fewer words than ``shingle`` is one shingle; equal texts are copies
and enter as one set with their count.

Edge cases: a null text is an empty one; texts without words link with their
copies only; repeated rows are copies; an empty table gives no rows; a null id
is never the smallest of its class.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, compared, components, first_columns, free_name, in_blocks, local_components, mixed, release, stage, table, whole_groups, word_hashes

COORDINATES = 128


def shingles(data: np.ndarray, ends: np.ndarray, n: int):
    """(hash, document) of the word n-grams of a run of documents; a shorter one is a single n-gram."""
    words, doc, _, _ = word_hashes(data, ends)
    count = np.bincount(doc, minlength=len(ends))
    out, of = np.zeros(len(words), np.uint64), np.zeros(0, np.int64)
    if not len(words):
        return out, of
    for k in range(n):
        shifted = np.zeros(len(words), np.uint64)
        same = np.zeros(len(words), bool)
        same[:len(words) - k] = doc[k:] == doc[:len(words) - k]
        shifted[:len(words) - k] = words[k:]
        out += np.where(same, mixed(shifted + np.uint64(k + 1)), np.uint64(0)) * np.uint64(2 * k + 0xC2B2AE3D27D4EB4F)
    first = np.cumsum(count) - count
    place = np.arange(len(words)) - first[doc]
    keep = place <= np.maximum(count[doc] - n, 0)
    return mixed(out[keep]), doc[keep]


def signatures(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """COORDINATES min-hashes (32 bits) for each document; all ones without shingles."""
    factors = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.full((n_docs, COORDINATES), 0xFFFFFFFF, np.uint64)
    ends = np.searchsorted(doc, np.arange(n_docs), "right")
    for d in range(n_docs):
        for at in range(ends[d - 1] if d else 0, ends[d], 2048):
            np.minimum(out[d], ((keys[at:min(at + 2048, ends[d]), None] * factors) >> np.uint64(32)).min(0), out=out[d])
    return out


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, k1, k2, n, sig, b0, b1): hashes of the text, number of
    shingles, signature and sketch (the lowest bit of each coordinate)."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for row, data, ends in chunks(batch.column(3)):
                keys, doc = shingles(data, ends, shingle)
                sig = signatures(keys, doc, len(ends))
                bits = np.packbits((mixed(sig + np.uint64(1)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                flat = pa.array(sig.astype(np.uint32).view(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, len(ends)) for c in range(3)], pa.array(np.bincount(doc, minlength=len(ends)).astype(np.int64)),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * COORDINATES), flat),
                                                  pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())], names=["doc_id", "k1", "k2", "n", "sig", "b0", "b1"])
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *text_key(F.col("text")), "text").mapInArrow(run, f"doc_id {ids}, k1 long, k2 long, n long, sig array<int>, b0 long, b1 long")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that tell texts apart."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def draws(threshold: float) -> tuple[int, float]:
    """Coordinates that a bucket draws: so many for sure, and one more with this chance."""
    sure = int(1 / threshold)
    return sure, 1 / threshold - sure


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a bucket of ``depth``
    with probability ``recall``: a pair stays together in a child with the threshold's probability."""
    sure, chance = draws(threshold)
    met = 1.0
    for _ in range(depth):
        met = 1 - (1 - threshold * met) ** sure * (1 - chance * threshold * met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def children(node: Column, threshold: float) -> Column:
    """The buckets that a set of signature ``sig`` goes on to from its bucket ``node``."""
    sure, chance = draws(threshold)

    def child(draw: int):
        drawn = F.pmod(F.xxhash64(node, F.lit(draw)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(node, F.lit(draw), F.get("sig", drawn))
    out = [child(d) for d in range(sure)]
    if chance > 0:
        out.append(F.when(F.pmod(F.xxhash64(node, F.lit(-1)), F.lit(1 << 20)) < int(chance * (1 << 20)), child(sure)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def candidates(texts: DataFrame, threshold: float, recall: float, leaf: int, first: int, depth: int, seed: int) -> DataFrame:
    """Edges (a, b) that connect all pairs of sets met in the buckets."""
    runs = runs_needed(threshold, recall, depth)
    nodes = F.array(*[F.xxhash64(F.lit(seed), F.lit(r)) for r in range(runs)])
    for _ in range(first):
        nodes = F.flatten(F.transform(nodes, lambda node: children(node, threshold)))
    rows = texts.where("n > 0").select("id", "b0", "b1", F.explode(nodes).alias("node"))
    # a sketch of as many bits errs by this much at the threshold; four of them are allowed for
    least = threshold - 4 * 2 * math.sqrt((1 + threshold) / 2 * (1 - threshold) / 2 / COORDINATES)
    small, written = None, []
    for level in range(first, depth + 1):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low")).where("size > 1")
        rows = stage(rows.join(counts, "node"), f"paths-level{level}")
        written.append(rows)
        few = rows.where(F.col("size") <= leaf)
        small = few if small is None else small.unionByName(few)
        rows = rows.where(F.col("size") > leaf).drop("size")
        if level < depth:
            rows = rows.join(texts.select("id", "sig"), "id").select("id", "b0", "b1", F.explode(children(F.col("node"), threshold)).alias("node"))
    whole = rows.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    edges = stage(compared(small, int((1 - least) / 2 * COORDINATES)).unionAll(whole), "paths-edges")
    release(*written)
    return edges


def intersections(groups: list[np.ndarray]):
    """For each set of sorted different keys: the sizes of its intersections with all sets."""
    keys = np.concatenate(groups)
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    order = np.argsort(keys, kind="stable")
    _, code, count = np.unique(keys, return_inverse=True, return_counts=True)
    start, members = np.cumsum(count) - count, of[order]
    at = 0
    for g in groups:
        mine = code[at:at + len(g)]
        at += len(g)
        mine = mine[count[mine] > 1]
        n = count[mine]
        lists = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.bincount(members[lists], minlength=len(groups))


def checked(rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """For each text of each block (see in_blocks): (id, links, root), the number
    of documents linked with it there, and the smallest id linked in the block directly or not."""
    limit = Fraction(str(threshold))
    num, den = limit.numerator, limit.denominator

    def run(batches):
        import pyarrow as pa
        for t in whole_groups(batches):
            g = t.column("_g").to_numpy()
            cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(g))):
                part = t.slice(a, b - a)
                ids, one = np.unique(part.column("id").to_numpy(), return_index=True)
                docs, chunk = part.column("n_docs").to_numpy()[one], part.column("_c").to_numpy()[one]
                cross = part.column("_i")[0].as_py() != part.column("_j")[0].as_py()
                found = {}
                for row, data, ends in chunks(part.column("text").take(pa.array(one)), 1 << 23):
                    keys, doc = shingles(data, ends, shingle)
                    stops = np.searchsorted(doc, np.arange(len(ends)), "right")
                    for d in range(len(ends)):
                        found[row + d] = np.unique(keys[stops[d - 1] if d else 0:stops[d]])
                own = [found[i] for i in range(len(ids))]
                size = np.array([len(x) for x in own])
                links, left, right = np.zeros(len(ids), np.int64), [], []
                for i, both in enumerate(intersections(own)):
                    linked = (both > 0) & (both * den >= num * (size + size[i] - both))
                    linked[i] = False
                    if cross:
                        linked &= chunk != chunk[i]
                    at = np.flatnonzero(linked)
                    links[i] = docs[at].sum()
                    at = at[at > i]
                    left.append(np.full(len(at), i))
                    right.append(at)
                lab = local_components(len(ids), np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[lab])], names=["id", "links", "root"])
    return rows.select("_g", "_i", "_j", "_c", "id", "n_docs", "text").repartition("_g").sortWithinPartitions("_g").mapInArrow(run, "id long, links long, root long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.9999,
            leaf: int = 256, first: int = 3, depth: int = 5, block: int = 512, seed: int = 0) -> DataFrame:
    """For each row of ``docs``: doc_id, k1, k2 (hashes of the text), class_id
    (smallest doc_id of its class), n_links (other documents at least
    ``threshold`` similar, copies included) and kept_key, the (doc_id, k1, k2)
    of the one document that stands for the class."""
    docs = first_columns(docs, doc_id=id_col, text=text_col)
    texts = sets(docs, shingle).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("n").alias("n"),
                                                        F.first("sig").alias("sig"), F.first("b0").alias("b0"), F.first("b1").alias("b1"))
    # ids are numbers given at this one writing, and only read from then on
    texts = stage(texts.withColumn("id", F.monotonically_increasing_id()), "paths-texts")
    met = candidates(texts, threshold, recall, leaf, first, depth, seed)
    near = stage(components(met, "paths-candidates"), "paths-components")
    release(met)
    members = near.join(texts.select("id", "k1", "k2", "rep", "n_docs", "n"), "id")
    members = stage(in_blocks(members, "component", F.col("id"), block, F.greatest(F.lit(1.0), F.col("n") / 2000)), "paths-blocks")
    source = docs.select("doc_id", *text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    texts_of = source.alias("d").join(members.alias("m").hint("shuffle_hash"), (F.col("d.k1") == F.col("m.k1")) & (F.col("d.k2") == F.col("m.k2")) & F.col("d.doc_id").eqNullSafe(F.col("m.rep")))
    found = stage(checked(texts_of.select("_g", "_i", "_j", "_c", "id", "n_docs", "text"), shingle, threshold), "paths-links")
    linked = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "paths-classes")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = texts.select("id", "k1", "k2", "rep", "n_docs").join(linked, "id", "left").join(links, "id", "left")
    result = stage(result.withColumn("component", F.coalesce("component", "id")), "paths-result")
    release(texts, near, members, found)
    lead = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), "k1", "k2")
    leads = result.groupBy("component").agg(F.min(lead).alias("lead"))
    out = result.join(leads, "component").select("k1", "k2", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
                                                 F.col("lead.doc_id").alias("class_id"), F.struct("lead.doc_id", "lead.k1", "lead.k2").alias("kept_key"))
    return docs.select("doc_id", *text_key(F.col("text"))).join(out, ["k1", "k2"]).select("doc_id", "k1", "k2", "class_id", "n_links", "kept_key")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each class: that of the smallest id."""
    a, b, k1, k2, own = (free_name(docs, x) for x in ("_a", "_b", "_k1", "_k2", "_own"))
    kept = classes(docs, id_col, text_col, **options).select("kept_key.*").distinct()
    kept = kept.select(F.col("doc_id").alias(own), F.col("k1").alias(k1), F.col("k2").alias(k2))
    keyed = docs.withColumns(dict(zip((a, b), text_key(F.col(text_col)))))
    out = keyed.join(kept.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(own)) & (F.col(a) == F.col(k1)) & (F.col(b) == F.col(k2)), "left_semi")
    return out.dropDuplicates([id_col, a, b]).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
texts AS (SELECT text, min(doc_id) AS id, count(*) AS n_docs, any_value(w) AS w FROM words GROUP BY text),
grams AS (
  SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
size AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
pair AS (
  SELECT a.id AS a, b.id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id
  JOIN size x ON x.id = a.id JOIN size y ON y.id = b.id GROUP BY a.id, b.id, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b),
class AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
link AS (SELECT p.a AS id, sum(t.n_docs) AS n FROM pair p JOIN texts t ON t.id = p.b GROUP BY p.a)
SELECT w.doc_id, c.class_id, (t.n_docs - 1 + coalesce(l.n, 0))::BIGINT AS n_links
FROM words w JOIN texts t USING (text) JOIN class c USING (id) LEFT JOIN link l USING (id)
"""
