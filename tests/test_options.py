"""Split joins, as-of joins, train-side encodings, refreshed lags, and bundles that are published whole."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillcast.operators import series
from tillcast.operators.asof import asof_join
from tillcast.operators.ordered import exact_medians
from tillcast.operators.skew import heavy_keys, split_join
from tillcast.sources.sinks import read_bundle, write_bundle

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_is_the_join(spark, how):
    rows = [("hot" if i % 3 else f"k{i % 50}", i, None if i % 7 == 0 else "x") for i in range(900)] + [(None, 1, "n"), (None, 1, "n")]
    big = spark.createDataFrame(rows, "k string, v int, note string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k3", 4), ("k3", 4), (None, 5)], "k string, w int")
    heavy = {r.k: r._split for r in heavy_keys(big, "k", 20).collect()}
    assert set(heavy) == {"hot"} and 12 <= heavy["hot"] <= 14
    want = sorted(map(str, big.join(small, "k", how).collect()))
    assert sorted(map(str, split_join(big, small, "k", how, 20).collect())) == want


def test_split_join_deals_the_hot_key_evenly(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(8000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
        small = spark.range(-1, 8000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        got = split_join(big, small, "k", "inner", 40).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        sizes = sorted(r["count"] for r in got)
        assert sum(sizes) == 8000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_asof_takes_the_latest_reading_with_gaps_and_ties(spark):
    rng = random.Random(1)
    start = dt.datetime(2025, 1, 1)
    readings = [(start + dt.timedelta(hours=rng.randrange(0, 24 * 200)), i, float(i)) for i in range(60)] + [(start + dt.timedelta(days=50), 100 + i, 7.0 + i) for i in range(3)] + [(None, 999, 1.0)]
    readings = [(t, i, None if i == 5 else v) for t, i, v in readings]
    rows = [(start + dt.timedelta(days=rng.randrange(-5, 260)), i) for i in range(200)] + [(start + dt.timedelta(days=50), 900), (None, 901)]
    r = spark.createDataFrame(readings, "t timestamp, id int, v double")
    f = spark.createDataFrame(rows, "day timestamp, n int")
    want = {}
    for t, n in rows:
        best = max(((a, i, v) for a, i, v in readings if t is not None and a is not None and a <= t), default=None, key=lambda x: x[:2])
        want[n] = best[2] if best else None
    for width in (3600 * 5, 86400 * 7, 86400 * 1000):
        got = {x.n: x.v for x in asof_join(f, r, "day", "t", "id", ["v"], width).collect()}
        assert got == want
    assert {x.v for x in asof_join(f, r.limit(0), "day", "t", "id", ["v"]).collect()} == {None}


def test_state_of_the_forecast_day_is_that_of_the_next_day(spark):
    days = [dt.datetime(2025, 1, 1) + dt.timedelta(days=k) for k in (0, 1, 2, 4, 5, 9, 10, 11)]
    totals = [10.0, 20.0, 5.0, 40.0, 7.0, 9.0, 30.0, 11.0]
    daily = spark.createDataFrame([(d, x, x / 2, 3) for d, x in zip(days, totals)], "invoice_date timestamp, day_total double, day_qty double, day_count long")
    t = pd.Series(totals)
    got = series.advanced_to(daily, "invoice_date").collect()
    assert len(got) == 1 and got[0].forecast_day == dt.datetime(2025, 1, 13)
    assert got[0].PrevDayTotalSale == 11.0 and got[0].PrevDayRowCount == 3.0
    assert got[0].DailyRoll3 == pytest.approx(t[-3:].mean()) and got[0].DailyRoll7 == pytest.approx(t[-7:].mean())
    assert got[0].DailyEWM3 == pytest.approx(t.ewm(span=3).mean().iloc[-1]) and got[0].DailyEWM5 == pytest.approx(t.ewm(span=5).mean().iloc[-1])
    back = series.advanced_to(daily, "invoice_date", "2025-01-09").first()
    assert back.PrevDayTotalSale == 0.0 and back.DailyRoll2 == pytest.approx(23.5)  # days after the forecast day do not count


def test_train_side_encoding_holds_no_value_of_the_line_or_of_test_lines(spark):
    from tillcast.catalog import plan
    from tillcast.plans.train_side import train_side_encoding
    fp = plan(spark, SF_SMALL)
    f = train_side_encoding(fp).select("material_no", "invoice_date", "_v", "is_train", "TE_Train_Mat").toPandas()
    train = f[f.is_train == 1]
    prior = train._v.mean()
    for m, own in list(f.groupby("material_no"))[:40]:
        known = own[own.is_train == 1]
        for r in own.itertuples():
            use = known[known.invoice_date < r.invoice_date] if r.is_train else known
            assert r.TE_Train_Mat == pytest.approx((use._v.sum() + 5.0 * prior) / (len(use) + 5.0))


def test_medians_of_near_unique_and_repeated_values(spark):
    rng = random.Random(4)
    rows = [("a", rng.random()) for _ in range(30000)] + [("b", float(rng.randrange(3))) for _ in range(5000)] + [("c", 1.0), ("c", 2.0), ("d", 5.0), ("e", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k").v.median().dropna().to_dict()
    for accuracy in (2000, 50):
        got = exact_medians(df, [("m", "k", "v"), ("all", None, "v")], accuracy=accuracy).collect()
        assert {r._key: r.median for r in got if r._stat == "m"} == want
        assert [r.median for r in got if r._stat == "all"] == [pytest.approx(pd.Series([v for _, v in rows]).median(), abs=0)]


def test_bundle_is_published_whole_or_not(spark, tmp_path):
    root = str(tmp_path / "bundle")
    assert read_bundle(spark, root) == {}
    one, two = spark.range(3), spark.range(5)
    write_bundle(root, {"a": one, "b": one}, {"train_r2": 0.5})
    assert {k: v.count() for k, v in read_bundle(spark, root).items()} == {"a": 3, "b": 3, "metrics": 1}
    broken = two.select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_bundle(root, {"a": two, "b": broken})
    assert {k: v.count() for k, v in read_bundle(spark, root).items()} == {"a": 3, "b": 3, "metrics": 1}
    write_bundle(root, {"a": two})
    assert {k: v.count() for k, v in read_bundle(spark, root).items()} == {"a": 5}
