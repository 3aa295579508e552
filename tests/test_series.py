"""Daily series goldens (FIXTURES.md: date_gap, ewm, rolling, two_level_dow)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillcast.operators import series

VALUES = [10, 20, 5, 40, 7, 9, 30]


def _daily(spark, values, days=None):
    days = days or list(range(1, len(values) + 1))
    rows = [(dt.datetime(2025, 1, d), float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "invoice_date timestamp, day_total double")


def test_rolling_and_ewm_goldens(spark):
    d = series.with_day_index(_daily(spark, VALUES), "invoice_date")
    out = series.earlier_day_means(d).orderBy("invoice_date").toPandas()
    assert out["DailyRoll3"].round(4).tolist() == [0.0, 10.0, 15.0, 11.6667, 21.6667, 17.3333, 18.6667]
    assert out["DailyEWM3"].round(6).tolist() == [0.0, 10.0, 16.666667, 10.0, 26.0, 16.193548, 12.539683]


def test_ewm_equals_pandas_long_series(spark):
    vals = [float((i * 37) % 101) for i in range(300)]
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    df = spark.createDataFrame(list(zip(days, vals)), "invoice_date timestamp, day_total double")
    out = series.earlier_day_means(series.with_day_index(df, "invoice_date")).orderBy("invoice_date").toPandas()
    s = pd.Series(vals).shift(1)
    for span in (3, 5):
        ref = s.ewm(span=span, min_periods=1).mean().fillna(0)
        assert out[f"DailyEWM{span}"].tolist() == pytest.approx(ref.tolist(), rel=1e-12, abs=1e-9)
    for n in (2, 3, 5, 7):
        ref = s.rolling(n, min_periods=1).mean().fillna(0)
        assert out[f"DailyRoll{n}"].tolist() == pytest.approx(ref.tolist(), rel=1e-12)


def test_date_gap_prev_day_and_roll(spark):
    d = series.with_day_index(_daily(spark, [100.0, 200.0, 400.0], [1, 2, 4]), "invoice_date")
    d = d.withColumn("day_qty", F.lit(1.0)).withColumn("day_count", F.lit(1))
    out = series.earlier_day_means(series.prev_calendar_day(d, "invoice_date")).orderBy("invoice_date").toPandas()
    assert out["PrevDayTotalSale"].tolist() == [0.0, 100.0, 0.0]
    assert out["DailyRoll2"].tolist()[2] == 150.0


def test_two_level_dow(spark):
    rows = [(dt.datetime(2025, 3, 3), 10.0), (dt.datetime(2025, 3, 10), 30.0)]  # two Mondays
    df = spark.createDataFrame(rows, "invoice_date timestamp, day_total double")
    out = series.dow_average_total(df, "invoice_date").collect()
    assert [(r.DayOfWeek, r.DOW_AvgDailyTotal) for r in out] == [(0, 20.0)]


def test_keyed_series_independent(spark):
    rows = [("a", dt.datetime(2025, 1, d), float(d)) for d in range(1, 5)] + \
           [("b", dt.datetime(2025, 1, d), 100.0) for d in range(1, 5)]
    df = spark.createDataFrame(rows, "k string, day date, day_total double")
    out = series.earlier_day_means(series.with_day_index(df, "day", ["k"]), keys=["k"]).toPandas()
    b = out[out.k == "b"].sort_values("day")
    assert b["DailyRoll7"].tolist() == [0.0, 100.0, 100.0, 100.0]


@pytest.mark.parametrize("null_at", [None, 40, 0])
def test_old_days_of_any_size_keep_their_weight(spark, null_at):
    """One day of 1e25, then 300 days of 10; a day without a total counts in no mean."""
    vals = [1e25] + [10.0] * 300
    if null_at is not None:
        vals[null_at] = None
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(len(vals))]
    df = spark.createDataFrame(list(zip(days, vals)), "invoice_date timestamp, day_total double")
    out = series.earlier_day_means(series.with_day_index(df, "invoice_date")).orderBy("invoice_date").toPandas()
    s = pd.Series(vals, dtype=float).shift(1)
    for span in (3, 5):
        ref = s.ewm(span=span, min_periods=1).mean().fillna(0)
        assert out[f"DailyEWM{span}"].tolist() == pytest.approx(ref.tolist(), rel=1e-9)
    for n in (2, 3, 5, 7):
        ref = s.rolling(n, min_periods=1).mean().fillna(0)
        # pandas keeps a running sum, which 1e25 spoils for later windows
        assert out[f"DailyRoll{n}"].tolist()[n + 2:] == pytest.approx([10.0] * (len(vals) - n - 2)) and out[f"DailyRoll{n}"][1] == pytest.approx(ref[1])


def test_ewm_over_many_blocks_of_several_series(spark):
    # more than 8 blocks, so that block sums are carried in two steps, beside a short series
    rng = np.random.default_rng(3)
    long, short = rng.uniform(1, 1000, 8 * series.BLOCK + 200), rng.uniform(1, 1000, 5)
    start = dt.datetime(2001, 1, 1)
    rows = [("a", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(long)] + [("b", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(short)]
    daily = spark.createDataFrame(rows, "k string, day timestamp, day_total double")
    got = series.earlier_day_means(series.with_day_index(daily, "day", ["k"]), keys=["k"]).toPandas().sort_values(["k", "day"])
    assert len(got) == len(rows)
    for k, values in (("a", long), ("b", short)):
        want = pd.Series(values).ewm(span=5).mean().shift(1).fillna(0.0).to_numpy()
        assert np.allclose(got[got.k == k].DailyEWM5.to_numpy(), want, rtol=1e-9)
