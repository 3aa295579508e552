"""Operator 11: alignment of two tokenizers by common token ends.

A document is encoded by a byte-level BPE (A, which gets a blank before the
text) and by a sentencepiece model (B, which adds the blank itself), so both
cut the same bytes. For either side a dictionary leads from the byte where a
token ends to the token's index. The hash sets of their keys are intersected;
the sorted common ends slice both lists of ids into groups, and within a group
every A token is linked with the B tokens whose bytes it shares: all of them
where one side is a single token, else by walking both sides' ends.

How often two ids are linked in the corpus is counted by blocks: a block is a
run of documents with about ``links`` links, its different id pairs are written
once with their counts, and documents point into the block's list. Blocks' pairs
are summed in Spark, the sums go back to the blocks, and each block is scored by
one bounded cogroup. Nothing of the corpus passes through the driver.

Edge cases: a null or empty text, or one that either side does not give back
byte for byte (sentencepiece turns U+2581 into a blank), has no tokens: zeros
and an empty digest; special tokens written out in a text are plain text; repeated rows
and null ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_columns, stage, table
from .tokens import byte_bpe, load_byte_bpe, load_pieces, piece_bytes

LINKS = 1 << 20
WIDTH = 1 << 20  # ids of a side; a pair is a * WIDTH + b
FIGURES = "n_a long, n_b long, n_groups long, n_links long"


def cut(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each group, where it ends in either list of ids."""
    index_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    if len(common) < 2:  # itemgetter gives one item bare
        return np.array([index_a[e] for e in common], np.int64), np.array([index_b[e] for e in common], np.int64)
    pick = itemgetter(*common)
    return np.frombuffer(array("q", pick(index_a)), np.int64), np.frombuffer(array("q", pick(index_b)), np.int64)


def links(ends_a: list[int], ends_b: list[int], cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (A, B) of all tokens that share a byte, group by group."""
    first_a, first_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    n_a, n_b = cut_a - first_a, cut_b - first_b
    size = n_a + n_b - 1  # no ends within a group meet
    group = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    # one token on a side is linked with every token of the other
    a = first_a[group] + np.where(n_a[group] > 1, at, 0)
    b = first_b[group] + np.where(n_b[group] > 1, at, 0)
    starts = np.cumsum(size) - size
    for g in np.flatnonzero((n_a > 1) & (n_b > 1)).tolist():
        i, j, k = int(first_a[g]), int(first_b[g]), int(starts[g])
        for k in range(k, k + int(size[g])):
            a[k], b[k] = i, j
            if ends_a[i] <= ends_b[j]:
                i += 1
            else:
                j += 1
    return a, b


def shown(n: int, mark: bytes) -> np.ndarray:
    """Ids below n (seven digits at most) as text with a mark behind, each in eight bytes filled up with NUL."""
    return np.char.add(np.char.mod(b"%d", np.arange(n)), mark).astype("S8").view(np.uint64)


def digest(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, names: tuple) -> str:
    """SHA-256 of `a1,a2|b1;a3|b2,b3`."""
    import hashlib
    inner_a, last_a, inner_b, last_b = names
    out = np.empty(len(a) + len(b), np.uint64)
    before_a, before_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    at_a = np.arange(len(a)) + np.repeat(before_b, cut_a - before_a)
    at_b = np.arange(len(b)) + np.repeat(cut_a, cut_b - before_b)
    out[at_a], out[at_b] = inner_a[a], inner_b[b]
    out[at_a[cut_a - 1]], out[at_b[cut_b - 1]] = last_a[a[cut_a - 1]], last_b[b[cut_b - 1]]
    return hashlib.sha256(out.tobytes().translate(None, b"\0")[:-1]).hexdigest()


class Aligner:
    """Both tokenizers, loaded once a task."""

    def __init__(self, a: dict, b: bytes):
        import sentencepiece
        self.encode_a = byte_bpe(a, special=False)
        self.encode_b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of_a = {i: t for t, i in a["ranks"].items()}
        self.bytes_a = [of_a.get(i, b"") for i in range(max(of_a) + 1)]
        self.bytes_b = piece_bytes(self.encode_b)
        self.length_a, self.length_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.names = shown(n_a, b","), shown(n_a, b"|"), shown(n_b, b","), shown(n_b, b";")

    def __call__(self, text: str | None):
        """(ids A, ids B, group ends in A, group ends in B, links A, links B), or None without tokens."""
        if not text:
            return None
        a, b = np.frombuffer(array("q", self.encode_a(" " + text)), np.int64), self.encode_b.encode(text)
        want = (" " + text).encode()
        ends_a = np.cumsum(self.length_a[a]).tolist()
        # byte-level tokens are the bytes that were cut; only the other side can lose some
        if ends_a[-1] != len(want) or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        b = np.frombuffer(array("q", b), np.int64)
        ends_b = np.cumsum(self.length_b[b]).tolist()
        cut_a, cut_b = cut(ends_a, ends_b)
        return a, b, cut_a, cut_b, *links(ends_a, ends_b, cut_a, cut_b)


def blocks(docs: DataFrame, a, b, most: int) -> DataFrame:
    """Rows of documents (block, doc_id, figures, groups_sha256, slots, times: the
    different id pairs of the document as places in the block's list and how
    often they are linked) and of blocks (block, pairs, pair_times: that list)."""
    def run(batches):
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext
        aligner, number = None, TaskContext.get().partitionId() << 32
        rows, codes, held = [], [], 0

        def arrays(values: np.ndarray, sizes, kind):
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

        def closed():
            of, pairs = pd.factorize(np.concatenate([np.zeros(0, np.int64), *codes]))
            doc = np.repeat(np.arange(len(rows)), [len(c) for c in codes])
            slot, different = pd.factorize(doc * max(len(pairs), 1) + of)
            sizes = np.bincount(different // max(len(pairs), 1), minlength=len(rows))
            n = len(rows)
            none = pa.nulls(1, pa.string())
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * n), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.string()),
                arrays(different % max(len(pairs), 1), sizes, pa.int32()), arrays(np.bincount(slot, minlength=len(different)), sizes, pa.int64()),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), *(pa.nulls(1, pa.int64()) for _ in range(5)), none, pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())),
                arrays(pairs, [len(pairs)], pa.int64()), arrays(np.bincount(of, minlength=len(pairs)), [len(pairs)], pa.int64())], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                aligner = aligner or Aligner(a.value, b.value)
                found = aligner(text.as_py())
                if found is None:
                    rows.append((doc_id, 0, 0, 0, 0, ""))
                    codes.append(np.zeros(0, np.int64))
                else:
                    ids_a, ids_b, cut_a, cut_b, at_a, at_b = found
                    rows.append((doc_id, len(ids_a), len(ids_b), len(cut_a), len(at_a), digest(ids_a, ids_b, cut_a, cut_b, aligner.names)))
                    codes.append(ids_a[at_a] * WIDTH + ids_b[at_b])
                held += len(codes[-1])
                if held >= most or len(rows) >= 1 << 16:
                    yield from closed()
                    number, rows, codes, held = number + 1, [], [], 0
        if rows:
            yield from closed()

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times", "pairs", "pair_times"]
    return docs.select("doc_id", "text").mapInArrow(run, f"block long, doc_id long, {FIGURES}, groups_sha256 string, slots array<int>, times array<long>, pairs array<long>, pair_times array<long>")


def scored(rows: DataFrame, looked: DataFrame) -> DataFrame:
    """Documents of ``blocks`` with n_best and count_sum, from the rows (of, slot, n, best) of their lists."""
    def run(left, right):
        import pyarrow as pa
        size = right.num_rows
        n, best = np.zeros(size, np.int64), np.zeros(size, bool)
        at = right.column("slot").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        slots, times = (left.column(c).combine_chunks() for c in ("slots", "times"))
        sizes = np.diff(slots.offsets.to_numpy())
        slot, times = slots.flatten().to_numpy(), times.flatten().to_numpy()
        doc = np.repeat(np.arange(left.num_rows), sizes)
        total, good = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        np.add.at(total, doc, n[slot] * times)
        np.add.at(good, doc, best[slot] * times)
        return pa.table([left.column("doc_id"), *(left.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(good), pa.array(total), left.column("groups_sha256")],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    docs = rows.where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times")
    return docs.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(run, f"doc_id long, {FIGURES}, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, most: int = LINKS) -> DataFrame:
    """One row per document with its alignment's figures and digest."""
    sc = docs.sparkSession.sparkContext
    a, b = sc.broadcast(load_byte_bpe(path_a)), sc.broadcast(load_pieces(path_b))  # the size of the two files
    docs = first_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stage(blocks(docs, a, b, most), "alignment-blocks")
    entries = (rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("slot", "_e"))
               .select("block", "slot", F.col("_e.pairs").alias("pair"), F.col("_e.pair_times").alias("times")))
    counts = stage(entries.groupBy("pair").agg(F.sum("times").alias("n")), "alignment-counts")
    # one row an id of B: no more than its vocabulary
    highest = counts.groupBy((F.col("pair") % WIDTH).alias("b")).agg(F.max("n").alias("top"))
    judged = counts.join(F.broadcast(highest), F.col("pair") % WIDTH == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return scored(rows, entries.join(judged, "pair").select(F.col("block").alias("of"), "slot", "n", "best"))


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The corpus table itself: rows (a, b, n) of linked ids."""
    sc = docs.sparkSession.sparkContext
    a, b = sc.broadcast(load_byte_bpe(path_a)), sc.broadcast(load_pieces(path_b))
    docs = first_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = blocks(docs, a, b, LINKS).where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "pair_times")).alias("_e"))
    return (rows.groupBy(F.col("_e.pairs").alias("_p")).agg(F.sum("_e.pair_times").alias("n"))
            .select(F.shiftright("_p", 20).cast("int").alias("a"), (F.col("_p") % WIDTH).cast("int").alias("b"), "n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
