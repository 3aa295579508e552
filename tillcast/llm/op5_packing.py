"""Operator 5: best-fit packing by minimum bin slack.

Documents are tokenised, cut where longer than a sequence, and packed into as
few sequences as the method can. What packing needs is only how many pieces
there are of each length, a table of at most ``capacity`` rows however large
the corpus is. Minimum bin slack runs on that table: the longest piece left
opens a bin, a bitset subset-sum over the lengths still available finds the
fullest feasible filling, and that combination is taken as often as the counts
allow before the next is searched. Pieces then take their places by their
number among the pieces of equal length, which is given out in blocks.

Edge cases: a null text is an empty one (its one piece is the closing id); an
empty table gives no rows; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_columns, number_within, stage, table
from .tokens import byte_bpe, load_byte_bpe

PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary) -> DataFrame:
    """One row per piece of (doc_id, text): documents longer than ``capacity``
    are cut into full pieces, of which only the first may be shorter."""
    def run(batches):
        import zlib

        import pyarrow as pa
        encode = byte_bpe(vocabulary.value, special=True)
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(np.array(encode(text.as_py() or ""), "<u4"), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(row, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            of, *cols = (pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *cols], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, {PIECES}")


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum within ``room``:
    bit s of ``reach`` tells that sum s can be made; copies of a length are
    tried in powers of two."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, k, had in reversed(steps):
        if not had >> best & 1:
            best -= length * k
            taken[length] = taken.get(length, 0) + k
    return taken


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations (times, {length: copies}) that use up all counts."""
    counts = {k: v for k, v in counts.items() if v}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        taken = fullest(counts, [x for x in lengths if x <= capacity - top], capacity - top)
        counts[top] += 1
        taken[top] = taken.get(top, 0) + 1
        times = min(counts[x] // n for x, n in taken.items())
        for x, n in taken.items():
            counts[x] -= n * times
        out.append((times, taken))
        lengths = [x for x in lengths if counts[x]]
    return out


def places(combinations: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first number, copies a bin, first bin, first offset), sorted:
    where the pieces of a length go, by their number. A combination has fewer
    than 64 different lengths within 2,048, so the table is small whatever the input."""
    rows, used, base = [], {}, 0
    for times, taken in combinations:
        offset = 0
        for length, copies in sorted(taken.items(), reverse=True):
            at = used.get(length, 0)
            rows.append((length, at, copies, base, offset))
            used[length] = at + times * copies
            offset += length * copies
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
         tokenizer_path: str | None = None) -> DataFrame:
    """Packs all documents: one row per piece with doc_id, piece, start, length,
    ids_crc32, sequence_id and offset (the piece's place in its sequence)."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_byte_bpe(tokenizer_path))
    cut = stage(pieces(first_columns(docs, doc_id=id_col, text=text_col), capacity, end_id, vocabulary), "packing-pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(places(minimum_bin_slack(counts, capacity)))
    numbered = number_within(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "number", sum(counts.values()))

    def put(batches):
        import pyarrow as pa
        p = plan.value
        key = (p[:, 0] << 44) + p[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            row = p[np.searchsorted(key, (length << 44) + number, "right") - 1]
            at = number - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + at // row[:, 2]), pa.array(row[:, 4] + at % row[:, 2] * length)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(put, f"doc_id {id_type(cut)}, {PIECES}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
