"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the bytes of UTF-8 (ASCII lower-cased;
"character" below means one such byte), one of toxic
and one of ordinary labelled documents, give a text two log-likelihoods; their
difference a character, and its size against the noise expected of the text's
length, are ranked by a logistic fit and turned into a probability by isotonic
regression, which keeps the order.

- The highest order (five bytes, which is few letters in other scripts than Latin) counts occurrences in the class, the
  orders below it count in how many different contexts a sequence occurs.
- Orders one and two are shared: their counts come from all documents, labelled
  or not, and both classes back off to them, so that an expression too rare to
  tell anything counts alike for both. The discount of the highest order is
  large for the same reason, and scaled to the size of each class.
- Counts are grouped by Spark over exact sequences, and scoring looks exact
  sequences up: one that was not seen backs off. Up to ``BROADCAST`` log ratios
  are sent to the tasks as sorted arrays; more stay in a table, which is joined
  with the different sequences of the texts.

At most ``max_documents`` labelled documents of each class are learnt from (the
first by hash of their id); a quarter of them is kept from the counts, and the
logistic and isotonic fits are made on that quarter.

Edge cases: a null or empty text, or one without a letter or digit, gets the
share of toxic documents among the labelled ones; contradicting or null labels
are not learnt from; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, first_columns, free_name, release, stage, table

ORDER, SHARED = 5, 2
BROADCAST = 4_000_000  # log ratios of 12 bytes that are sent to the tasks at most
#: Lower case; white space and ASCII punctuation are blanks.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[65:91] += 32
LETTERS[[*range(33), *b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = 32


def sequences(data: np.ndarray, ends: np.ndarray):
    """The last ORDER characters (bytes) up to each character of a run of
    documents, packed into 40 bits with the latest lowest, and each one's
    document. Runs of blanks are one; a document begins after blanks."""
    s = LETTERS[data]
    blank = s == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    doc = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))[keep]
    at = np.arange(len(doc)) + (ORDER - 1) * (doc + 1)
    spaced = np.full(len(doc) + (ORDER - 1) * len(ends), 32, np.int64)
    spaced[at] = s[keep]
    packed = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        packed |= spaced[at - k] << (8 * k)
    return packed, doc


def low(packed, k: int):
    """The last k characters."""
    return packed & ((1 << 8 * k) - 1)


def tallied(runs, most: int = 1 << 20):
    """From sorted arrays of keys: (keys, counts) summed over as many runs as have
    ``most`` different keys at most, so that a task holds no more."""
    def summed(held):
        keys, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[new], np.add.reduceat(counts[order], new)
    held, size = [], 0
    for keys in runs:
        if not len(keys):
            continue
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        held.append((keys[new], np.diff(np.append(new, len(keys)))))
        size += len(new)
        if size > most:
            held = [summed(held)]
            size = len(held[0][0])
            if size > most // 2:
                yield held.pop()
                size = 0
    if held:
        yield summed(held)


def class_counts(docs: DataFrame) -> DataFrame:
    """Exact counts (gram, n0, n1) of sequences in the texts of ``mark`` 0 and 1."""
    def run(batches):
        import pyarrow as pa

        def runs():
            for batch in batches:
                mark = batch.column(0).to_numpy()
                for row, data, ends in chunks(batch.column(1)):
                    g, doc = sequences(data, ends)
                    yield np.sort(g * 2 + mark[row:row + len(ends)][doc])
        for both, n in tallied(runs()):
            yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(np.where(both & 1, 0, n)), pa.array(np.where(both & 1, n, 0))], names=["gram", "n0", "n1"])
    return docs.select("mark", "text").mapInArrow(run, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_counts(docs: DataFrame) -> DataFrame:
    """Counts (gram, n) of three-character sequences in all documents."""
    def run(batches):
        import pyarrow as pa
        runs = (np.sort(low(sequences(data, ends)[0], 3).astype(np.uint32)) for batch in batches for _, data, ends in chunks(batch.column(0)))
        for gram, n in tallied(runs):
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n)], names=["gram", "n"])
    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def shared_model(spark: SparkSession, trigrams: DataFrame, discount: float = 0.75) -> DataFrame:
    """P(b | a) for all 65,536 pairs, from the number of different contexts."""
    import pyarrow as pa
    pairs = np.zeros((256, 256))
    found = trigrams.groupBy((F.col("gram") % 65536).alias("pair")).count().toArrow()  # 65,536 rows at most
    pairs.ravel()[found.column(0).to_numpy()] = found.column(1).to_numpy()
    one = ((pairs > 0).sum(0) + 0.5) / ((pairs > 0).sum() + 128)
    total = pairs.sum(1, keepdims=True)
    p = np.where(total > 0, (np.maximum(pairs - discount, 0) + np.minimum(pairs, discount).sum(1, keepdims=True) * one) / np.maximum(total, 1), one)
    return spark.createDataFrame(pa.table({"gram": np.arange(65536), "p": p.ravel()}))


def log_ratios(top: DataFrame, shared: DataFrame, discount: float) -> DataFrame:
    """Rows (kind, gram, value): kind k holds log P1/P0 of the sequences of order
    k seen in either class, kind 10 + k the log ratio of what their contexts
    leave to the order below."""
    by_order, written = {ORDER: top}, []
    # no table of this function has more rows than the top one (contexts and lower orders are fewer)
    files = max(1, math.ceil(top.count() / 200_000))
    put = lambda df, name: stage(df.coalesce(files), name)
    for k in range(ORDER - 1, SHARED, -1):  # in how many different contexts
        above = by_order[k + 1]
        by_order[k] = put(above.groupBy((F.col("gram") % (1 << 8 * k)).alias("gram")).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("n0", "n1")]), f"toxicity-order{k}")
        written.append(by_order[k])
    lower, out = shared.select("gram", F.col("p").alias("p0"), F.col("p").alias("p1")), None
    for k in range(SHARED + 1, ORDER + 1):
        totals = by_order[k].agg(F.sum("n0"), F.sum("n1")).first()
        d = [discount * max(1.0, t / max(min(totals), 1)) for t in totals]
        grams = by_order[k].withColumns({"context": F.shiftright("gram", 8), "suffix": F.col("gram") % (1 << 8 * (k - 1))})
        left = [F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(d[c]))).alias(f"l{c}") for c in (0, 1)]
        contexts = put(grams.groupBy("context").agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in (0, 1)], *left), f"toxicity-contexts{k}")
        share = [F.when(F.col(f"s{c}") > 0, F.col(f"l{c}") / F.col(f"s{c}")).otherwise(1.0) for c in (0, 1)]
        seen = [F.when(F.col(f"s{c}") > 0, F.greatest(F.col(f"n{c}") - F.lit(d[c]), F.lit(0.0)) / F.col(f"s{c}")).otherwise(0.0) for c in (0, 1)]
        lower = put(grams.join(contexts, "context").join(lower.withColumnRenamed("gram", "suffix"), "suffix")
                      .select("gram", *[(seen[c] + share[c] * F.col(f"p{c}")).alias(f"p{c}") for c in (0, 1)]), f"toxicity-p{k}")
        written += [contexts, lower]
        value = lower.select(F.lit(k).alias("kind"), "gram", F.log(F.col("p1") / F.col("p0")).alias("value")).unionAll(
            contexts.select(F.lit(10 + k), "context", F.log(share[1] / share[0])))
        out = value if out is None else out.unionAll(value)
    ratios = stage(out.select("kind", "gram", F.col("value").cast("float").alias("value")), "toxicity-ratios")
    release(*written)
    return ratios


def sorted_tables(ratios: DataFrame) -> dict:
    """For each kind the sequences, sorted, and their log ratios."""
    tables = {}
    for k in range(SHARED + 1, ORDER + 1):
        for kind in (k, 10 + k):
            part = ratios.where(F.col("kind") == kind).select("gram", "value").toArrow()  # BROADCAST rows at most in all
            gram, value = (part.column(c).to_numpy() for c in (0, 1))
            at = np.argsort(gram)
            tables[kind] = gram[at], value[at]
    return tables


def looked_up(table: tuple[np.ndarray, np.ndarray], gram: np.ndarray) -> np.ndarray:
    """The values of sequences, NaN where the table does not hold them."""
    keys, values = table
    if not len(keys):
        return np.full(len(gram), np.nan, np.float32)
    at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
    return np.where(keys[at] == gram, values[at], np.float32(np.nan))


def backed_off(tables: dict, gram: np.ndarray) -> np.ndarray:
    """log P1/P0 of the last character of each sequence after the others: a
    sequence not seen takes what its context leaves and the order below."""
    total, at = np.zeros(len(gram)), np.arange(len(gram))
    for k in range(ORDER, SHARED, -1):
        found = looked_up(tables[k], low(gram[at], k))
        missing = np.isnan(found)
        total[at[~missing]] += found[~missing]
        at = at[missing]
        total[at] += np.nan_to_num(looked_up(tables[10 + k], low(gram[at] >> 8, k - 1)))
    return total


def joined_ratios(grams: DataFrame, ratios: DataFrame) -> DataFrame:
    """Rows (gram, value) for rows (gram) without repeats: ``backed_off`` as joins."""
    out, missing = grams.withColumn("value", F.lit(0.0)), F.lit(True)
    for k in range(ORDER, SHARED, -1):
        of = [ratios.where(F.col("kind") == kind).select(F.col("gram").alias(f"key{kind}"), F.col("value").cast("double").alias(f"value{kind}")) for kind in (k, 10 + k)]
        out = out.withColumns({f"key{k}": F.col("gram") % (1 << 8 * k), f"key{10 + k}": F.shiftright("gram", 8) % (1 << 8 * (k - 1))})
        out = out.join(of[0], f"key{k}", "left").join(of[1], f"key{10 + k}", "left")
        step = F.coalesce(F.col(f"value{k}"), F.col(f"value{10 + k}"), F.lit(0.0))
        out = out.withColumn("value", F.col("value") + F.when(missing, step).otherwise(0.0))
        missing = missing & F.col(f"value{k}").isNull()
    return out.select("gram", "value")


def characters(doc: np.ndarray, packed: np.ndarray, docs: int) -> np.ndarray:
    """Characters of each document, 0 where none is a letter or digit."""
    n = np.bincount(doc, minlength=docs)
    n[np.bincount(doc, low(packed, 1) != 32, minlength=docs) == 0] = 0
    return n.astype(np.int64)


def joined_likelihood_ratio(docs: DataFrame, ratios: DataFrame, text_col: str, ratio: str, n: str) -> DataFrame:
    """``likelihood_ratio`` by joins, for more log ratios than are sent to the tasks."""
    row = free_name(docs, "_row")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "toxicity-rows")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for first, data, ends in chunks(batch.column(1)):
                g, doc = sequences(data, ends)
                size = characters(doc, g, len(ends))
                order = np.lexsort((g, doc))
                g, doc = g[order], doc[order]
                new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))[:len(g)])
                ids = batch.column(0).to_numpy()[first:first + len(ends)]
                times = np.diff(np.append(new, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[new]]), pa.array(g[new]), pa.array(times), pa.array(size[doc[new]])], names=["row", "gram", "times", "size"])

    found = stage(docs.select(row, F.col(f"`{text_col}`")).mapInArrow(run, "row long, gram long, times long, size long"), "toxicity-sequences")
    values = stage(joined_ratios(found.select("gram").distinct(), ratios), "toxicity-values")
    # summed as decimals, so that the order of rows does not matter
    sums = found.join(values, "gram").groupBy("row").agg(F.sum((F.col("value") * F.col("times")).cast("decimal(28,12)")).cast("double").alias("total"), F.max("size").alias("size"))
    sums = stage(sums.select(F.col("row").alias(row), (F.col("total") / F.greatest(F.col("size"), F.lit(1))).alias("_total"), F.col("size").alias("_size")), "toxicity-sums")
    release(found, values)
    total, size = free_name(docs, "_total"), free_name(docs, "_size")
    sums = sums.withColumnsRenamed({"_total": total, "_size": size})
    kept = [F.col(f"`{c}`") for c in docs.columns if c != row]
    return docs.join(sums, row, "left").select(*kept, F.coalesce(total, F.lit(0.0)).alias(ratio), F.coalesce(size, F.lit(0)).cast("long").alias(n))


def likelihood_ratio(docs: DataFrame, tables, text_col: str = "text", ratio: str = "_ratio", n: str = "_n") -> DataFrame:
    """Adds ``ratio`` (log-likelihood difference a character) and ``n`` (characters) to the rows of
    ``docs``; ``tables`` is a broadcast of ``sorted_tables`` or the table of ``log_ratios``."""
    if isinstance(tables, DataFrame):
        return joined_likelihood_ratio(docs, tables, text_col, ratio, n)
    text_at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ratio, T.DoubleType()), T.StructField(n, T.LongType())])
    names = schema.fieldNames()

    def run(batches):
        import pyarrow as pa
        t = tables.value
        for batch in batches:
            for row, data, ends in chunks(batch.column(text_at)):
                g, doc = sequences(data, ends)
                different, of = np.unique(g, return_inverse=True)
                total = backed_off(t, different)[of]
                size = characters(doc, g, len(ends))
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(ends)).columns, pa.array(np.bincount(doc, total, minlength=len(ends)) / np.maximum(size, 1)), pa.array(size)], names=names)
    return docs.mapInArrow(run, schema)


def features(ratio, n, sqrt, log):
    """What the logistic fit sees; the same for NumPy arrays and for columns."""
    return [ratio * 10, ratio * sqrt(n), log(n + 1.0)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last one the intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-9]) * weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 100_000, discount: float = 0.75, broadcast: int = BROADCAST) -> dict | None:
    """The fitted model for the rows (id, mark) of ``labels`` and (id, text) of ``docs``; None without both classes."""
    spark = docs.sparkSession
    marks = labels.where("mark in (0, 1) and id is not null").groupBy("id").agg(F.min("mark").alias("mark"), F.max("mark").alias("_high")).where("mark = _high").select("id", F.col("mark").cast("int").alias("mark"))
    marks = stage(marks, "toxicity-marks")
    size = {r[0]: r[1] for r in marks.groupBy("mark").count().collect()}
    if len(size) < 2:
        return None
    picked = None
    for mark in (0, 1):
        some = marks.where(F.col("mark") == mark).orderBy(F.xxhash64("id"), "id").limit(max_documents)
        picked = some if picked is None else picked.unionAll(some)
    fitted = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0
    # at most 2 x max_documents ids are sent to the tasks
    learnt = docs.join(F.broadcast(picked), "id").dropDuplicates(["id"])
    learnt = stage(learnt.select("id", "text", "mark", fitted.alias("fitted")), "toxicity-sample")
    if learnt.select("mark", "fitted").distinct().count() < 4:  # both parts need both classes
        return None
    # about 2,000 documents a task, so that a sequence is sent on by few tasks
    tasks = max(1, math.ceil(sum(min(n, max_documents) for n in size.values()) / 2000))
    top = stage(class_counts(learnt.where("not fitted").coalesce(tasks)), "toxicity-counts")
    shared = shared_model(spark, shared_counts(docs))
    ratios = log_ratios(top, shared, discount)
    release(top)
    small = ratios.count() <= broadcast
    tables = spark.sparkContext.broadcast(sorted_tables(ratios)) if small else ratios
    seen = likelihood_ratio(learnt.where("fitted").select("id", "mark", "text"), tables).where("_n > 0").select("id", "mark", "_ratio", "_n").toPandas()
    release(marks, learnt, *([ratios] if small else []))
    if seen.mark.nunique() < 2:
        return None
    seen = seen.sort_values(["id"])
    weight = seen.mark.map({m: size[m] / (seen.mark == m).sum() for m in (0, 1)}).to_numpy()
    ratio, n = seen._ratio.to_numpy(), seen._n.to_numpy().astype(float)
    x = np.column_stack(features(ratio, n, np.sqrt, np.log))
    y = seen.mark.to_numpy()
    w = logistic(x, y, weight / weight.mean())
    steps = isotonic(np.column_stack([x, np.ones(len(x))]) @ w, y, weight)
    return {"tables": tables, "weights": w.tolist(), "steps": steps, "share": size[1] / (size[0] + size[1])}


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[float, float]]:
    """Points (z, probability) of the best rising fit of y: neighbours that fall
    are pooled. A block's probability counts one further document of each class
    shared out by weight, so that it is never 0 or 1."""
    blocks: list[list[float]] = []  # sum of z, of y, of weight
    prior = float((y * weight).sum() / weight.sum())
    for i in np.argsort(z, kind="stable"):
        blocks.append([z[i] * weight[i], y[i] * weight[i], weight[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    unit = float(np.mean(weight))
    points = [(b[0] / b[2], (b[1] + prior * unit) / (b[2] + unit)) for b in blocks]
    high, out = 0.0, []
    for at, p in points:
        high = max(high, p)
        out.append((float(at), float(high)))
    return out


def probability(model: dict, ratio: str = "_ratio", n: str = "_n"):
    """The score as a column, of ``ratio`` and ``n``."""
    *w, bias = model["weights"]
    z = sum((F.lit(a) * x for a, x in zip(w, features(F.col(ratio), F.col(n), F.sqrt, F.log))), F.lit(bias))
    # between the points of the isotonic fit the probability rises in a line; a
    # small share of the logistic fit keeps the order within its flat parts
    (z0, p0), *rest = model["steps"]
    p = F.when(z <= z0, F.lit(p0))
    for z1, p1 in rest:
        if z1 > z0:
            p = p.when(z <= z1, p0 + (z - z0) * ((p1 - p0) / (z1 - z0)))
        z0, p0 = z1, p1
    flat = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return F.when(F.col(n) > 0, 0.99 * p.otherwise(F.lit(p0)) + 0.01 * flat).otherwise(model["share"])


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (probability that the text is toxic) and predicted (1 from ``threshold`` on) of each document."""
    docs = first_columns(docs, doc_id=id_col, text=text_col)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    out = likelihood_ratio(docs, model["tables"]).select("doc_id", probability(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    if model is None:
        return docs
    ratio, n = free_name(docs, "_ratio"), free_name(docs, "_n")
    return likelihood_ratio(docs, model["tables"], text_col, ratio, n).where(probability(model, ratio, n) < threshold).drop(ratio, n)


def held_out(id_column):
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, **options) -> dict | None:
    """The model of the query and the pipeline: labels of rows that are not held out."""
    marks = first_columns(labels, id="doc_id", mark="toxic").where(~held_out(F.col("id")))
    return train(first_columns(docs, id="doc_id", text="text"), marks, **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
