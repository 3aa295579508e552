"""Operator 3: quality classifier by co-training.

Two logistic classifiers see a document through separate views: its text
(shares of letters, capitals, symbols, copies, ... and the spread of its words)
and its metadata (language, source, stated length). Both start from the
labelled documents. In every round each one scores all unlabelled documents and
hands the ``exchange`` most confident ones of each class, if it is sure of them
by ``sure``, to the other as pseudo-labels; both are then fitted again. Their
outputs are calibrated on labelled documents kept from the fits, and the two
views' evidence is added: log odds of both, less the log odds of the prior once.

At most ``max_labelled`` labelled documents (the first by hash of their id) are
learnt from, a fifth of them for calibration. Each language and source among
them has a weight of its own, and so have null and, together, all others; the
weights are joined to the documents by name. The views of all documents are
written once as short rows; rounds and the final scores run over all of them.

Edge cases: a null text is an empty one, null metadata is a value of its own;
contradicting or null labels are not learnt from; without labels of both
classes every score is 1 (everything stays); repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, first_columns, free_name, mixed, release, stage, table
from .lines import measure
from .op6_toxicity import logistic

TEXT_VIEW = ["letters", "upper", "digits", "symbols", "exclaims", "bars", "stops", "ending stops", "log words", "word length",
             "same word again", "copied lines", "foreign bytes", "repeated words", "different words", "log words a line"]
LENGTHS = 24


def views(docs: DataFrame, text_col: str, lang_col: str, source_col: str, length_col: str, names: tuple[str, str] = ("_text", "_meta")) -> DataFrame:
    """Adds the columns ``names``: numbers of the text view, and the names of
    language and source ("" for null, "=" before others) and the class of lengths."""
    length = F.when(F.col(length_col) >= 0, F.least(F.floor(F.log2(F.col(length_col) + 1.0)), F.lit(LENGTHS - 2)) + 1).otherwise(0)
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (lang_col, source_col)]
    meta = F.array(*named, length.cast("string"))
    docs = docs.withColumn(names[1], meta)
    text_at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.DoubleType()))])
    fields = schema.fieldNames()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for row, data, ends in chunks(batch.column(text_at)):
                got = measure(data, ends)
                n, doc = len(ends), got["line_doc"]
                words = np.maximum(got["n_words"], 1)
                # shares of lines weighted by their words; x: see lines.FEATURES
                x = np.stack([np.bincount(doc, got["x"][:, j] * got["line_words"], minlength=n) / words for j in range(1, got["x"].shape[1])], axis=1)
                _, first = np.unique(mixed(got["words"] + got["word_doc"].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True)
                different = np.bincount(got["word_doc"][first], minlength=n) / words
                view = np.column_stack([x[:, :8], np.log1p(got["n_words"]), got["word_chars"] / words, x[:, 11], x[:, 12], x[:, 13], got["n_repeat_words"] / words,
                                        different, np.log(words / np.maximum(np.bincount(doc, got["line_words"] > 0, minlength=n), 1))])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * view.shape[1]), pa.array(view.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(row, n).columns, flat], names=fields)
    return docs.mapInArrow(run, schema)


def text_logit(w, mean, scale, name: str = "_text"):
    """Log odds of the text view as a column."""
    return sum((F.lit(float(a / s)) * (F.col(name)[i] - F.lit(float(m))) for i, (a, m, s) in enumerate(zip(w[:-1], mean, scale))), F.lit(float(w[-1])))


def vocabulary(meta) -> list[dict]:
    """Places of the weights: for language, source and length the place of each name; None is any other."""
    out, at = [], 0
    for names in [*(sorted({m[j] for m in meta} | {""}) for j in (0, 1)), [str(k) for k in range(LENGTHS)]]:
        out.append({name: at + i for i, name in enumerate([None, *names])})
        at += len(out[-1])
    return out


def on(meta, places: list[dict]) -> np.ndarray:
    """Which three indicators of each row are on."""
    return np.array([[p.get(name, p[None]) for p, name in zip(places, m)] for m in meta], np.int64).reshape(-1, 3)


def indicator_logistic(on: np.ndarray, size: int, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """``logistic`` for rows given by the places of their ones: Newton's method
    with steps by conjugate gradients, so that no square of ``size`` is held."""
    at = np.column_stack([on, np.full(len(on), size)])
    total = lambda v: np.bincount(at.ravel(), np.repeat(v, at.shape[1]), size + 1)
    penalty, w = np.append(np.full(size, ridge), 1e-9) * len(y), np.zeros(size + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(1), -30, 30)))
        grad, h = total(y - p) - penalty * w, p * (1 - p)
        diagonal = total(h) + penalty + 1e-9
        step, left = np.zeros(size + 1), grad.copy()
        to = left / diagonal
        along, size_left = to, left @ to
        for _ in range(1000):
            if np.abs(left).max() < 1e-9:
                break
            turned = total(h * along[at].sum(1)) + (penalty + 1e-9) * along
            rate = size_left / (along @ turned)
            step, left = step + rate * along, left - rate * turned
            to = left / diagonal
            before, size_left = size_left, left @ to
            along = to + size_left / before * along
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def with_meta_logit(df: DataFrame, meta: tuple, out: str, name: str = "_meta") -> DataFrame:
    """Adds ``out``, the log odds of the metadata view: the weights of languages
    and sources, no more than labelled rows, are sent to the tasks and joined by name."""
    import pyarrow as pa
    w, places = meta
    kept, z = [F.col(f"`{c}`") for c in df.columns], F.lit(float(w[-1]))
    for j, place in enumerate(places):
        key, weight = free_name(df, f"_name{j}"), free_name(df, f"_weight{j}")
        names = [n for n in place if n is not None]
        table_ = df.sparkSession.createDataFrame(pa.table({key: pa.array(names, pa.string()), weight: pa.array([float(w[place[n]]) for n in names])}))
        df = df.join(F.broadcast(table_), F.col(name)[j] == F.col(key), "left")
        z = z + F.coalesce(F.col(weight), F.lit(float(w[place[None]])))
    return df.select(*kept, z.alias(out))


def train(seen: DataFrame, labels: DataFrame, max_labelled: int = 20000, rounds: int = 3, exchange: int = 500, sure: float = 0.95) -> dict | None:
    """The fitted pair for rows of ``views`` and rows (id, mark); None without both classes."""
    marks = labels.where("mark in (0, 1) and id is not null").groupBy("id").agg(F.min("mark").alias("mark"), F.max("mark").alias("_high")).where("mark = _high")
    marks = stage(marks.orderBy(F.xxhash64("id"), "id").limit(max_labelled).select("id", F.col("mark").cast("int").alias("mark"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)) == 0).alias("kept")), "quality-marks")
    labelled = seen.join(F.broadcast(marks), "id").dropDuplicates(["id"]).toPandas().sort_values("id")  # max_labelled rows at most
    fit, rest = labelled[~labelled.kept], labelled[labelled.kept]
    if fit.mark.nunique() < 2 or rest.mark.nunique() < 2:
        return None
    stack = lambda frame, name: np.array([list(x) for x in frame[name]])
    mean, scale = stack(fit, "_text").mean(0), stack(fit, "_text").std(0) + 1e-6
    places = vocabulary(labelled["_meta"])
    width = sum(map(len, places))
    pool = seen.join(F.broadcast(marks.select("id")), "id", "left_anti")
    extra = {"text": [], "meta": []}  # pseudo-labels given to each view
    given: set = set()
    for step in range(rounds + 1):
        xt = np.array([list(t) for t in fit["_text"]] + [r._text for r, _ in extra["text"]])
        yt = np.concatenate([fit.mark.to_numpy(), [y for _, y in extra["text"]]])
        xm = on([*fit["_meta"], *[r._meta for r, _ in extra["meta"]]], places)
        ym = np.concatenate([fit.mark.to_numpy(), [y for _, y in extra["meta"]]])
        wt = logistic((xt - mean) / scale, yt, np.ones(len(yt)))
        wm = indicator_logistic(xm, width, ym)
        if step == rounds:
            break
        bound = float(np.log(sure / (1 - sure)))
        judged = (pool.withColumn("_z", text_logit(wt, mean, scale)), "meta"), (with_meta_logit(pool, (wm, places), "_z"), "text")
        for scored, other in judged:
            for y, sign in ((1, 1), (0, -1)):
                # the most confident of all documents, ties by hash; what was handed over before stays so
                best = scored.withColumn("z", F.col("_z") * sign).where(F.col("z") >= bound).orderBy(F.desc("z"), F.xxhash64("id"), "id").limit(exchange * (step + 1)).select("id", "_text", "_meta").collect()
                for r in best:
                    if (other, r.id) not in given:
                        given.add((other, r.id))
                        extra[other].append((r, y))
    release(marks)
    # calibration of each view on documents kept from the fits
    y = rest.mark.to_numpy()
    zt = (stack(rest, "_text") - mean) / scale @ wt[:-1] + wt[-1]
    zm = wm[on(rest["_meta"], places)].sum(1) + wm[-1]
    ct, cm = (logistic(z[:, None] / 4, y, np.ones(len(y)), ridge=1e-4) for z in (np.clip(zt, -20, 20), np.clip(zm, -20, 20)))
    prior = (y.sum() + 0.5) / (len(y) + 1)
    return {"text": (wt, mean, scale), "meta": (wm, places), "calibration": (ct.tolist(), cm.tolist()), "prior": float(np.log(prior / (1 - prior))),
            "handed": {k: len(v) for k, v in extra.items()}}


def scores(model: dict, names: tuple[str, str] = ("_text", "_z")) -> tuple:
    """(content, metadata, combined) probabilities of good quality as columns of
    the text view and of what ``with_meta_logit`` added."""
    clip = lambda z: F.greatest(F.least(z, F.lit(20.0)), F.lit(-20.0))
    odds = lambda z: 1 / (1 + F.exp(-z))
    (at, bt), (am, bm) = model["calibration"]
    t, m = clip(text_logit(*model["text"], names[0])) / 4 * at + bt, clip(F.col(names[1])) / 4 * am + bm
    return odds(t), odds(m), odds(t + m - model["prior"])


COLUMNS = {"text_col": "text", "lang_col": "lang", "source_col": "source", "length_col": "n_chars"}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", columns: dict = COLUMNS, **options) -> tuple[DataFrame, dict | None]:
    """The written views (id, _text, _meta) of all documents and the model learnt from rows (id, mark) of ``labels``."""
    short = first_columns(docs, id=id_col, text=columns["text_col"], lang=columns["lang_col"], source=columns["source_col"], length=columns["length_col"])
    seen = stage(views(short, "text", "lang", "source", "length").select("id", "_text", "_meta"), "quality-views")
    return seen, train(seen, labels, **options)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, columns: dict = COLUMNS, **options) -> DataFrame:
    """doc_id, content_score, metadata_score, score and kept of all documents."""
    seen, model = learn(docs, labels, id_col, columns, **options)
    seen = with_meta_logit(seen, model["meta"], "_z") if model else seen
    content, metadata, both = scores(model) if model else [F.lit(1.0)] * 3
    out = seen.select(F.col("id").alias("doc_id"), content.alias("content_score"), metadata.alias("metadata_score"), both.alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)


def good(docs: DataFrame, model: dict | None, threshold: float = 0.5, columns: dict = COLUMNS) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    if model is None:
        return docs
    names = free_name(docs, "_text"), free_name(docs, "_meta")
    z = free_name(docs, "_z")
    judged = with_meta_logit(views(docs, **columns, names=names), model["meta"], z, names[1])
    return judged.where(scores(model, (names[0], z))[2] >= threshold).drop(*names, z)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), first_columns(table(spark, sf_dir, "labels"), id="doc_id", mark="quality"))
