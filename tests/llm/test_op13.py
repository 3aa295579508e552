"""Operator 13 against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import op13_hard_negatives as op13
from tillcast.llm.op13_hard_negatives import Index, cells_in_order


def brute(rows):
    use = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use[i] = (tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i % 7 == 0 else label)
    out = []
    for a, (x, label) in use.items():
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (y, _) in use.items() if i != a and len(y) == len(x)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if use[i][1] == label][:5]:
            fit = [i for i in order if use[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit)]
    return sorted(out)


def rows_of(seed, n, dimension):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dimension)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in c], rng.randrange(10)))
    same = rows[0][1]
    rows += [(n + i, same, i % 3) for i in range(300)]
    rows += [(10_000, None, 1), (10_001, [1.0, None] * (dimension // 2), 1), (10_002, [math.nan] * dimension, 1), (10_003, [math.inf] * dimension, 1), (10_100, same, None),
             (None, same, 1), (10_200, [0.0] * dimension, 3), (10_300, [1.0, 2.0], 3), (10_301, [1.0, 1.9], 3), (10_302, [0.5, 0.9], 4), (10_400, [], 1), rows[100], rows[101]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 5) for i, v, label in rows], "vec_id long, embedding array<float>, label int, x string, anchor int").repartition(4)


def changed():
    return F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("seed_rows, block, anchors", [(1, 64, 3), (4096, 2048, 1024)])
def test_against_brute_force(spark, monkeypatch, seed_rows, block, anchors):
    monkeypatch.setattr(op13, "BLOCK", block)
    monkeypatch.setattr(op13, "ANCHORS", anchors)
    rows = rows_of(1, 900, 8)
    got = op13.mine(frame(spark, rows), F.col("id") % 100 == 0, label=changed(), seed_rows=seed_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])


def test_empty_table_and_too_large_components(spark):
    empty = frame(spark, rows_of(1, 10, 4)).limit(0)
    assert op13.mine(empty, F.col("id") % 100 == 0).collect() == []
    with pytest.raises(ValueError):
        op13.mine(frame(spark, [(0, [1e18, 1.0], 1), (1, [1.0, 1.0], 1)]), F.col("id") % 100 == 0)


def test_query_on_a_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op13.query(spark, "/root/testdata/sf0.001").collect()) == brute(rows)


def test_cells_come_in_descending_order_and_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = list(cells_in_order(a, b))
    assert [round(s, 9) for s, _, _ in got] == [round(x, 9) for x in sorted((p + q for p in a for q in b), reverse=True)]
    assert len({(i, j) for _, i, j in got}) == 35
    x = rng.normal(size=(500, 6)) * 100
    words = [x[:9, :3], x[:8, 3:]]
    of = [op13.nearest(x[:, :3], words[0]), op13.nearest(x[:, 3:], words[1])]
    far = [np.sqrt(((part - book[o]) ** 2).sum(1)) for part, book, o in zip((x[:, :3], x[:, 3:]), words, of)]
    radii = [np.array([f[o == k].max(initial=0) for k in range(len(book))]) for f, o, book in zip(far, of, words)]
    sizes = {}
    for cell in zip(of[0].tolist(), of[1].tolist()):
        sizes[cell] = sizes.get(cell, 0) + 1
    index = Index(3, words, radii, sizes)
    vector = rng.normal(size=6) * 100
    score = x @ vector
    floor = np.sort(score)[-5]
    visited = set(index.visits(vector, floor))
    assert {(of[0][k], of[1][k]) for k in np.flatnonzero(score >= floor)} <= visited
    low = np.sort(score)[100]
    within = set(index.visits(vector, -math.inf, low))
    assert {(of[0][k], of[1][k]) for k in np.flatnonzero(score <= low)} <= within
    seeds = list(index.visits(vector, -math.inf, seed_rows=50))
    assert seeds + list(index.visits(vector, -math.inf, skip=len(seeds))) == list(index.visits(vector, -math.inf))
