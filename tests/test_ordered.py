"""Prefix counts, percent ranks, medians and label codes."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillcast.operators.ordered import (average_tie_pct_rank, dense_codes, exact_median, exact_medians,
                                        prefix_before)


def test_tied_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "x double")
    r = average_tie_pct_rank(df, "x", "pct")
    got = {row.x: row.pct for row in df.join(r, "x", "left").collect()}
    assert got == {1.0: 0.25, 2.0: 0.625, 4.0: 1.0, None: None}


@pytest.mark.parametrize("partitions", [1, 7])
def test_prefix_counts(spark, partitions):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", "hot", "hot", "hot"]), rnd.random(), rnd.randint(1, 5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double, w int")
    got = prefix_before(df, ["x"], "w", ["k"], "b", partitions).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "x", "w"]).sort_values(["k", "x"])
    pdf["b"] = pdf.groupby("k")["w"].cumsum() - pdf["w"]
    m = got.merge(pdf, on=["k", "x", "w"], suffixes=("", "_ref"))
    assert len(m) == len(rows)
    assert (m["b"] == m["b_ref"]).all()


def test_exact_median_matches_pandas(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c", "hot", "hot", "hot"]), float(rnd.randint(0, 40)))
            for _ in range(2000)] + [("single", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    ref = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].median().to_dict()
    assert got == pytest.approx(ref)
    allm = exact_medians(df, [("all", None, "v"), ("byk", "k", "v")]).collect()
    assert {(r._stat, r._key): r.median for r in allm}[("all", "")] == pytest.approx(
        pd.Series([v for _, v in rows]).median())


def test_label_codes_code_point_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("B",), ("é",), ("10",), ("9",), (None,), (None,)], "c string")
    got = {r.c: r.code for r in dense_codes(df, "c", "code").collect()}
    assert got == {"b": 4, "a": 3, "B": 2, "é": 5, "10": 0, "9": 1, None: 6}


def test_pct_rank_range(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("x"))
    r = average_tie_pct_rank(df, "x", "pct").collect()
    assert all(0 < row.pct <= 1 for row in r)


def test_pct_rank_matches_pandas_with_ties(spark):
    rnd = random.Random(11)
    vals = [float(rnd.randint(0, 60)) if rnd.random() > 0.05 else None for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = {row.x: row.pct for row in average_tie_pct_rank(df, "x", "pct").collect()}
    ref = pd.Series(vals, dtype="float64").rank(pct=True)
    for v, p in zip(vals, ref):
        if v is None:
            assert p != p
        else:
            assert r[v] == pytest.approx(p, rel=1e-12)
