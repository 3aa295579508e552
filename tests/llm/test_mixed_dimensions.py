"""Operator 10: each dimension by itself."""

import numpy as np

from tillcast.llm import op10_embedding_dedup
from tillcast.llm.common import local_components


def test_vectors_of_every_dimension_are_compared(spark):
    rng = np.random.default_rng(5)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [0.0, 2.0]), (5, [4.0]), (6, [-1.0]), (7, [2.0]), (8, [1.0] * 9)]
    for i in range(120):
        base = rng.normal(size=3) if i % 4 == 0 else base + rng.normal(size=3) * 0.2
        rows.append((100 + i, base.tolist()))
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, d int").repartition(3)
    want = []
    for d in {len(v) for _, v in rows}:
        own = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if len(v) == d]
        x = np.array([v for _, v in own])
        near = (x @ x.T >= 0.9) & ~np.eye(len(own), dtype=bool)
        lab = local_components(len(own), *np.nonzero(near))
        low = {k: min(i for (i, _), m in zip(own, lab) if m == k) for k in set(lab)}
        want += [(i, int(n), low[k], i == low[k]) for (i, _), n, k in zip(own, near.sum(1), lab)]
    assert sorted(tuple(r) for r in op10_embedding_dedup.near_duplicates(df).collect()) == sorted(want)
