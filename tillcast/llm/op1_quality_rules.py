"""Operator 1: quality rules with a linear-chain conditional random field.

The lines of a document are a sequence; Viterbi decoding marks each line as
content or boilerplate from line features (letters, symbols, stops, copies of
earlier lines, ...) and from the label of the line before. A document stays if
its base counts pass and content lines hold at least ``min_share`` of its words.

The field is fitted on lines of labelled documents: lines of documents marked
good are content, those of documents marked bad boilerplate. At most
``max_documents`` labelled documents of each mark and of up to ``max_lines``
lines (the first by hash) are used for the fit; decoding covers every line of
every document.

Edge cases: a null or empty text has one empty line, no words, and fails the
base rule; labels that contradict each other or are null are not learnt from;
without labels of both marks every line is content and the base rule alone
decides; repeated rows are judged each for itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, first_columns, table
from .lines import measure

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def by_length(n_lines: np.ndarray):
    """Documents from the longest down, and for each step how many are that long."""
    order = np.argsort(-n_lines, kind="stable")
    steps = np.arange(n_lines.max(initial=0))
    return order, np.searchsorted(-n_lines[order], -steps, "left")


def viterbi(model: dict, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Best label of each line (True: content), for all documents at once: step t
    treats the t-th line of every document that has one."""
    emit = (x - model["mean"]) / model["scale"] @ model["weights"]
    move, first = model["move"], np.cumsum(n_lines) - n_lines
    order, active = by_length(n_lines)
    first = first[order]
    v = np.zeros((2, len(first)))
    back = np.zeros((2, len(x)), bool)
    for t, m in enumerate(active):
        at = first[:m] + t
        if t == 0:
            v[0, :m], v[1, :m] = model["start"][0], model["start"][1] + emit[at]
            continue
        old = v[:, :m].copy()
        for s in (0, 1):
            stay, come = old[0] + move[0, s], old[1] + move[1, s]
            back[s, at] = come > stay
            v[s, :m] = np.maximum(stay, come) + s * emit[at]
    state, out = v[1] >= v[0], np.zeros(len(x), bool)
    for t in range(len(active) - 1, -1, -1):
        at = first[:active[t]] + t
        s = state[:active[t]].copy()
        out[at] = s
        state[:active[t]] = np.where(s, back[1, at], back[0, at])
    return out


def fit(x: np.ndarray, content: np.ndarray, n_lines: np.ndarray, steps: int = 150, decay: float = 1e-3) -> dict:
    """Maximum likelihood by gradient ascent (Adam); gradients from forward-backward marginals."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    z = (x - mean) / scale
    first = np.cumsum(n_lines) - n_lines
    order, active = by_length(n_lines)
    first, length = first[order], n_lines[order]
    y = content.astype(int)
    inner = np.ones(len(x), bool)
    inner[first] = False
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    seen_start = np.bincount(y[first], minlength=2)
    theta = np.zeros(z.shape[1] + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, move, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.stack([np.zeros(len(z)), z @ w])
        alpha, beta = np.zeros((2, len(z))), np.zeros((2, len(z)))
        for t, m in enumerate(active):
            at = first[:m] + t
            for s in (0, 1):
                alpha[s, at] = e[s, at] + (start[s] if t == 0 else np.logaddexp(alpha[0, at - 1] + move[0, s], alpha[1, at - 1] + move[1, s]))
        for t in range(len(active) - 2, -1, -1):
            at = first[:active[t + 1]] + t
            for s in (0, 1):
                beta[s, at] = np.logaddexp(beta[0, at + 1] + e[0, at + 1] + move[s, 0], beta[1, at + 1] + e[1, at + 1] + move[s, 1])
        last = first + length - 1
        total = np.zeros(len(z))
        total[first] = np.logaddexp(alpha[0, last], alpha[1, last])
        total = np.repeat(total[np.sort(first)], n_lines)
        p = np.exp(alpha[1] + beta[1] - total)
        here = np.flatnonzero(inner)
        pair = np.array([[np.exp(alpha[i, here - 1] + move[i, j] + e[j, here] + beta[j, here] - total[here]).sum() for j in (0, 1)] for i in (0, 1)])
        grad = np.concatenate([z.T @ (y - p), (seen_move - pair).ravel(), seen_start - np.array([(1 - p[first]).sum(), p[first].sum()])]) / len(z) - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        theta += 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return {"mean": mean, "scale": scale, "weights": theta[:-6], "move": theta[-6:-2].reshape(2, 2), "start": theta[-2:]}


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 1500, max_lines: int = 200) -> dict | None:
    """The field fitted on lines of labelled documents; None without both marks."""
    marks = first_columns(labels, id="doc_id", mark="quality").where("mark in (0, 1) and id is not null").groupBy("id").agg(F.min("mark").alias("mark"), F.max("mark").alias("_high")).where("mark = _high")
    picked = None
    for mark in (0, 1):
        some = marks.where(F.col("mark") == mark).orderBy(F.xxhash64("id"), "id").limit(max_documents).select("id", "mark")
        picked = some if picked is None else picked.unionAll(some)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for row, data, ends in chunks(batch.column(0)):
                got = measure(data, ends)
                n = np.bincount(got["line_doc"], minlength=len(ends))
                cut = np.cumsum(n)
                xs = [got["x"][b - k:b].ravel().tolist() if k <= max_lines else None for k, b in zip(n, cut)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, len(ends)), pa.array(xs, pa.list_(pa.float64()))], names=["mark", "x"])
    # at most 2 x max_documents ids are sent to the tasks
    rows = (first_columns(docs, id="doc_id", text="text").join(F.broadcast(picked), "id").dropDuplicates(["id"]).select("text", F.col("mark").cast("int").alias("mark"))
            .mapInArrow(run, "mark int, x array<double>").where("x is not null").collect())
    if len({r.mark for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.mark, r.x))
    from .lines import FEATURES
    x = np.concatenate([np.array(r.x).reshape(-1, len(FEATURES)) for r in rows])
    n = np.array([len(r.x) // len(FEATURES) for r in rows])
    return fit(x, np.repeat([r.mark == 1 for r in rows], n), n)


def judge(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
          max_repeat_percent: int = 30, min_share: float = 0.5, with_lines: bool = False) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, content_share and, if
    ``with_lines``, ``content``: for each line of the text whether it is content."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for row, data, ends in chunks(batch.column(1)):
                got = measure(data, ends)
                n_lines = np.bincount(got["line_doc"], minlength=len(ends))
                content = np.ones(len(got["x"]), bool) if model.value is None else viterbi(model.value, got["x"], n_lines)
                share = np.bincount(got["line_doc"], got["line_words"] * content, minlength=len(ends)) / np.maximum(got["n_words"], 1)
                failed = (got["n_words"] < min_words) | (100 * got["n_repeat_words"] > max_repeat_percent * got["n_words"])
                cols = [batch.column(0).slice(row, len(ends)), *[pa.array(got[c].astype(np.int64)) for c in COUNTS],
                        pa.array(failed), pa.array(~failed & (share >= min_share)), pa.array(share)]
                names = ["doc_id", *COUNTS, "base_failed", "kept", "content_share"]
                if with_lines:
                    cols.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(n_lines)).astype(np.int32), pa.array(content)))
                    names.append("content")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    ids = docs.schema[id_col].dataType.simpleString()
    return first_columns(docs, doc_id=id_col, text=text_col).mapInArrow(
        run, f"doc_id {ids}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, content_share double" + ", content array<boolean>" * with_lines)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
