"""Checked broadcast and scalar subqueries."""

import pytest

from tillcast.operators.stage import stage
from tillcast.operators.joins import checked_broadcast, join_checked, with_scalars


def _has_broadcast_hint(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_checked_broadcast_within_and_beyond_budget(spark):
    small = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, v double")
    small = stage(small, "small")
    assert _has_broadcast_hint(checked_broadcast(small))
    assert not _has_broadcast_hint(checked_broadcast(small, max_bytes=5))
    big = spark.range(50).withColumnRenamed("id", "k")
    rows = [sorted(map(tuple, join_checked(big, small, "k", max_bytes=n).collect()), key=str) for n in (1 << 20, 5)]
    assert rows[0] == rows[1] and len(rows[0]) == 50


def test_with_scalars_one_row_only(spark):
    df = spark.range(3)
    one = spark.createDataFrame([(2.5, "x")], "m double, s string")
    assert [(r.m, r.s) for r in with_scalars(df, one).collect()] == [(2.5, "x")] * 3
    two = spark.createDataFrame([(1.0,), (2.0,)], "m double")
    with pytest.raises(Exception):
        with_scalars(df, two).collect()
