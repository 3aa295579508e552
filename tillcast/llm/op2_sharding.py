"""Operator 2: sharding by vector bin packing (law ``bytes``).

Documents of equal text are a group, with a vector of bytes, tokens and rows,
each as a share of the whole table. Groups are placed from the largest down,
each into the shard whose residual capacity has the highest dot product with
the group's vector, so that all three are balanced jointly.

Scale: a group above 1/(64 x shards) of any dimension is large; there are fewer
than 3 x 64 x shards of them, and they are placed first, by the driver. All others
are dealt to blocks by hash, and every block fills its share of what the large
groups leave of each shard, in parallel. A group whose bytes are above one shard's
share is split by a hash of its rows (the law could not hold); no other group
is, however many rows it has.

Edge cases: a null text counts as an empty one (size 1); an empty table gives
no rows; repeated rows are rows of their group; ties go to the lowest shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_columns, number_within, stage, table

DIMENSIONS = ["bytes", "tokens", "rows"]


def place(vectors: list[tuple[float, ...]], room: list[list[float]]) -> list[int]:
    """Shard of each vector, in the order given; ``room`` (one list of residual
    capacities for each dimension) is used up. Dot products are with capacities
    as shares, so every dimension weighs alike."""
    shards, out = range(len(room[0])), []
    for v in vectors:
        best, most = 0, -math.inf
        for s in shards:
            dot = sum(x * r[s] for x, r in zip(v, room))
            if dot > most:
                best, most = s, dot
        for x, r in zip(v, room):
            r[best] -= x
        out.append(best)
    return out


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
           groups_per_block: int = 20000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    ``tokens``: a count made of the column ``text``; words parted by ASCII white space unless given."""
    spark = docs.sparkSession
    docs = first_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    if tokens is None:
        tokens = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = stage(docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                             tokens.cast("long").alias("tokens"), F.xxhash64("text").alias("g")), "sharding-rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = stage(groups, "sharding-groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS], F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = [(F.col(d) / max(total[d], 1)).alias(f"v_{d}") for d in DIMENSIONS]
    groups = groups.select("g", *share)
    most = F.greatest(*[f"v_{d}" for d in DIMENSIONS])

    # groups that no shard can hold, in pieces; then all large ones
    torn = [r.g for r in groups.where(F.col("v_bytes") > 1 / shards).select("g").collect()]  # fewer than ``shards``
    pieces = 8 * shards
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(1)), F.lit(pieces)).cast("int")
    if torn:
        cut = (rows.where(F.col("g").isin(torn)).groupBy("g", piece.alias("piece")).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
               .select("g", "piece", *share).collect())  # fewer than shards x pieces
    else:
        cut = []
    whole = groups.where((most > 1 / (64 * shards)) & ~F.col("g").isin(torn) if torn else most > 1 / (64 * shards)).collect()
    large = [(r.g, r.piece, pieces, (r.v_bytes, r.v_tokens, r.v_rows)) for r in cut] + [(r.g, 0, 1, (r.v_bytes, r.v_tokens, r.v_rows)) for r in whole]
    large.sort(key=lambda r: (-max(r[3]), r[0], r[1]))
    room = [[1 / shards] * shards for _ in DIMENSIONS]
    put = place([r[3] for r in large], room)
    chosen = spark.createDataFrame([(g, p, n, s) for (g, p, n, _), s in zip(large, put)], "g long, piece int, pieces int, shard int")
    # a shard that a group has filled beyond its share of tokens or rows still takes its share
    # of bytes, which the law is about, and the tokens and rows that come with them
    left = [sum(r) for r in room]
    for d in (1, 2):
        need = max(left[d], 0.0) / left[0] if left[0] > 0 else 0.0
        room[d] = [max(b, 0.0) * need if x <= 0 else x for x, b in zip(room[d], room[0])]
    left = [sum(r) for r in room]

    blocks = math.ceil(total.n / groups_per_block)

    def fill(pdf):
        pdf = pdf.assign(m=pdf[["v_bytes", "v_tokens", "v_rows"]].max(axis=1)).sort_values(["m", "g"], ascending=[False, True])
        vectors = list(pdf[["v_bytes", "v_tokens", "v_rows"]].itertuples(index=False, name=None))
        parts = [sum(v[d] for v in vectors) / left[d] if left[d] > 0 else 0.0 for d in range(len(room))]
        pdf["shard"] = place(vectors, [[x * part for x in r] for r, part in zip(room, parts)])
        return pdf[["g", "shard"]]

    small = (groups.join(F.broadcast(chosen.select("g").distinct()), "g", "left_anti").withColumn("block", F.pmod("g", F.lit(blocks)))
             .groupBy("block").applyInPandas(fill, "g long, shard int"))
    keep = ["doc_id", "size", "text_crc32", "shard"]
    by_size = F.broadcast(chosen.withColumnRenamed("g", "of"))
    placed = (rows.join(by_size, (F.col("g") == F.col("of")) & (F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(1)), F.col("pieces")) == F.col("piece"))).select(*keep)
              .unionAll(rows.join(F.broadcast(chosen.select("g").distinct()), "g", "left_anti").join(small, "g").select(*keep)))
    placed = stage(placed, "sharding-placed")
    out = number_within(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", total.rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents as Parquet, a folder for each shard, in slot order within each file."""
    key = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    where = assigned.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot").dropDuplicates(["_id", "_crc"])
    (docs.join(where, F.col(id_col).eqNullSafe(F.col("_id")) & (key == F.col("_crc"))).drop("_id", "_crc")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
