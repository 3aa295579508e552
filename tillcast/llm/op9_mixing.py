"""Operator 9: mixing sources to target weights, on DataFrame functions only.

Every source has a target number of words (``targets``). A source whose target
is r times its size gives floor(r) whole passes, and the rest of the target
from its documents in a random order: the order cuts the source into blocks,
whole blocks are drawn up to the target, and the block in which the target
falls gives the documents that fit it, filled up by its smallest others.

A multivariate-hypergeometric splitting tree deals the drawn blocks to output
shards: at each node the blocks are put in a random order and the left half of
the node's shards takes its exact number of them without replacement, so that
the numbers of each source's blocks on either side are multivariate
hypergeometric while all quotas stay exact. Blocks of shards are disjoint, and
rows are shuffled within their shard by a hash. All randomness is a hash of the
row and the seed: reruns agree whatever the partitions.

Scale: rows meet their source's figures by a salted join, and are ordered only
within blocks of about ``rows_per_block``; what is ordered beyond that are
tables of blocks and of sources.

Edge cases: a null text has size 0; a null source is a source of its own, the
last; a source without words has target 0; rows that are equal in all columns
are each counted; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, release, stage, table

SALTS = 64
SPAN = 1 << 40


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``sid`` (number in code-point order, null last), ``weight`` and
    ``target`` to rows (source, source_size).

    Targets are in proportion to the weights and sum to ``share`` of all sizes;
    one stops at ``most`` times its source's size, and what it gives up goes to
    the others by weight. Taken in the order of most * size / weight, the
    sources that stop come first; the level of the others is what those leave,
    divided by the weights that remain."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sources.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", weight)
    out = out.withColumn("cap", F.lit(most) * F.col("source_size"))
    up_to = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * share
    level = (total - (F.sum("cap").over(up_to) - F.col("cap"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(up_to) - F.col("weight")))
    out = out.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    # the first source that need not stop sets the level for all after it
    out = out.withColumn("level", F.max_by("level", F.when(F.col("level").isNotNull(), -F.col("cap") / F.col("weight"))).over(everything))
    return out.select("source", "source_size", "n", "sid", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def split_tree(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds ``shard`` to drawn blocks (sid, block, pass)."""
    out = blocks.withColumns({"lo": F.lit(0), "hi": F.lit(shards)})
    depth = 0
    while 1 << depth < shards:
        node = Window.partitionBy("lo", "hi")
        at = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(depth), "sid", "block", "pass"), "sid", "block", "pass"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        quota = F.round(F.count(F.lit(1)).over(node) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        out = out.withColumns({"mid": mid, "left": (F.col("hi") - F.col("lo") > 1) & (at <= quota)})
        out = out.withColumns({"lo": F.when(F.col("left") | (F.col("hi") - F.col("lo") == 1), F.col("lo")).otherwise(F.col("mid")),
                               "hi": F.when(F.col("left"), F.col("mid")).otherwise(F.col("hi"))}).drop("mid", "left")
        depth += 1
    return out.withColumn("shard", F.col("lo").cast("int")).drop("lo", "hi")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(5, 2, 1), share: float = 1.5,
         most: float = 2.0, shards: int = 8, seed: int = 0, rows_per_block: int = 1024) -> DataFrame:
    """For each row of ``docs``: doc_id, row_hash (of all columns), size,
    source_size, target, copies, taken and shards (one for each copy)."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), row_hash.alias("row_hash"))
    rows = read = stage(rows.withColumn("h", F.xxhash64("row_hash", F.lit(seed))), "mixing-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = targets(sources, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = stage(goals.withColumn("blocks", F.ceil(F.col("n") / rows_per_block)), "mixing-targets")

    salted = goals.select("source", "sid", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).alias("r").join(
        salted.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.salt") == F.col("s.salt")))
    rows = rows.select("doc_id", "size", "row_hash", "h", "sid", F.floor(F.pmod(F.col("h"), F.lit(SPAN)) / SPAN * F.col("blocks")).cast("long").alias("block"))
    dealt = stage(rows, "mixing-blocks")
    release(read)
    rows = dealt

    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("block_size"))
    before = F.sum("block_size").over(Window.partitionBy("sid").orderBy("block")) - F.col("block_size")
    blocks = blocks.withColumn("before", before).join(goals.select("sid", "source_size", "target", "whole", "rest"), "sid")
    blocks = stage(blocks.withColumn("room", F.col("rest") - F.col("before")), "mixing-quotas")
    release(goals)
    last = F.col("whole") + F.when(F.col("room") > 0, 1).otherwise(0)
    drawn = blocks.where(last > 0).select("sid", "block", F.explode(F.sequence(F.lit(0), last - 1)).alias("pass"))
    homes = split_tree(drawn, shards, seed).groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("homes"))
    blocks = blocks.join(homes, ["sid", "block"], "left")

    rows = rows.join(blocks, ["sid", "block"])
    all_in = F.col("room") >= F.col("block_size")
    order = Window.partitionBy("sid", "block").orderBy("h", "row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("fits", F.coalesce(F.sum("size").over(order) <= F.col("room"), F.lit(False)))
    got = F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(Window.partitionBy("sid", "block"))
    rows = rows.withColumn("open", F.col("room") - got)
    smallest = Window.partitionBy("sid", "block", "fits").orderBy("size", "h", "row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fills = ~F.col("fits") & (F.sum("size").over(smallest) - F.col("size") / 2 <= F.col("open"))
    picked = (F.col("room") > 0) & (all_in | F.col("fits") | fills)
    copies = (F.col("whole") + picked.cast("int")).cast("int")
    homes = F.slice(F.transform(F.coalesce("homes", F.array().cast("array<struct<pass:int,shard:int>>")), lambda x: x["shard"]), F.lit(1), copies)
    return rows.select("doc_id", "row_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), homes.alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", seed: int = 0, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as drawn, with
    ``_shard`` (the last column), in a random order within each shard of a partition."""
    own, row, home, copy, shard = (free_name(docs, x) for x in ("_own", "_row", "_home", "_copy", "_shard"))
    planned = plan(docs, id_col, seed=seed, **options)
    # rows equal in all columns are interchangeable: one of them stands for all their copies
    drawn = planned.where("copies > 0").groupBy(F.col("doc_id").alias(own), F.col("row_hash").alias(f"{row}_of")).agg(F.flatten(F.collect_list("shards")).alias(home))
    keyed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).dropDuplicates([row, id_col])
    out = keyed.join(drawn, (F.col(row) == F.col(f"{row}_of")) & F.col(id_col).eqNullSafe(F.col(own)))
    out = out.select(*[f"`{c}`" for c in docs.columns], row, F.posexplode(home).alias(copy, shard))
    return out.sortWithinPartitions(shard, F.xxhash64(F.lit(seed), row, copy)).drop(row, copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
