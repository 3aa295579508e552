"""Calendar, festive, traffic and weather parsing goldens."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tillcast.functions import calendar as cal
from tillcast.sources.weather import parse_weather, weather_context


def _dates(spark, ds):
    return spark.createDataFrame([(d,) for d in ds], "d date")


def test_festive_edges(spark):
    ds = [dt.date(2025, 1, 12), dt.date(2025, 1, 13), dt.date(2025, 1, 17), dt.date(2025, 1, 18),
          dt.date(2025, 8, 24), dt.date(2025, 8, 25), dt.date(2025, 8, 31), dt.date(2025, 9, 1),
          dt.date(2025, 10, 31), dt.date(2025, 11, 10), dt.date(2025, 11, 11)]
    out = _dates(spark, ds).select(cal.is_festive(F.month("d"), F.dayofmonth("d")).alias("f")).collect()
    assert [r.f for r in out] == [0, 1, 1, 0, 0, 1, 1, 0, 1, 1, 0]


def test_seasons(spark):
    ds = [dt.date(2025, m, 1) for m in range(1, 13)]
    out = _dates(spark, ds).select(cal.season_name(F.month("d")).alias("s"),
                                   cal.season_code(F.month("d")).alias("c")).collect()
    assert [r.s[:2] if r.s != "Winter" else "W" for r in out] == \
        ["W", "W", "Su", "Su", "Su", "So", "So", "So", "So", "No", "No", "W"]
    assert [r.c for r in out] == [0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 0]


def test_traffic_and_delay(spark):
    df = spark.createDataFrame([(d, r) for d in range(7) for r in (0, 1)], "dow int, rainy int")
    out = {(r.dow, r.rainy): (r.t, r.dl) for r in df.select(
        "dow", "rainy", cal.traffic_index("dow", "rainy").alias("t"),
        cal.delay_index("dow", "rainy").alias("dl")).collect()}
    assert out[(0, 0)][0] == pytest.approx(0.78)
    assert out[(5, 1)][0] == pytest.approx(0.98)
    assert out[(6, 1)][0] == pytest.approx(0.95)
    assert out[(5, 1)][1] == pytest.approx(0.70)
    assert out[(3, 0)][1] == pytest.approx(0.20)


def test_weekday_monday_zero(spark):
    out = _dates(spark, [dt.date(2025, 3, 22), dt.date(2025, 3, 24)]).select(cal.weekday("d").alias("w")).collect()
    assert [r.w for r in out] == [5, 0]


def test_dayfirst_parse(spark):
    df = spark.createDataFrame([("03/04/2025",), ("2025-04-03 00:00:00",)], "s string")
    out = df.select(cal.parse_dayfirst("s").alias("t")).collect()
    assert [r.t.date() for r in out] == [dt.date(2025, 4, 3), dt.date(2025, 4, 3)]


def _payload(t, h, w, wid, rain=None):
    p = {"main": {"temp": t, "humidity": h}, "wind": {"speed": w}, "weather": [{"id": wid}]}
    if rain is not None:
        p["rain"] = {"1h": rain}
    return json.dumps(p)


def _ctx(spark, recs):
    df = spark.createDataFrame(recs, "city string, status int, payload string")
    return weather_context(parse_weather(df)).first()


def test_weather_both_ok_mean(spark):
    r = _ctx(spark, [("A", 200, _payload(30.0, 70, 4.0, 501, 1.0)), ("B", 200, _payload(20.0, 50, 2.0, 800))])
    assert (r.temperature, r.humidity, r.wind_speed, r.rain_1h, r.is_rainy) == (25.0, 60.0, 3.0, 0.5, 1)


def test_weather_one_failed(spark):
    r = _ctx(spark, [("A", 500, _payload(30.0, 70, 4.0, 501)), ("B", 200, _payload(20.0, 50, 2.0, 800))])
    assert (r.temperature, r.is_rainy) == (20.0, 0)


def test_weather_all_failed_defaults(spark):
    r = _ctx(spark, [("A", 500, "oops"), ("B", 200, "{not json")])
    assert (r.temperature, r.humidity, r.wind_speed, r.rain_1h, r.is_rainy) == (30.0, 68.0, 5.0, 0.0, 0)
    assert r.heat_index == pytest.approx(30 + 0.33 * (0.68 * 6.105 * 2.718281828459045 ** (17.27 * 30 / 267.7)) - 4)


def test_forecast_day_context(spark):
    from tillcast.plans.reports import forecast_day_context
    df = spark.createDataFrame([("A", 200, _payload(30.0, 70, 4.0, 501, 1.0)), ("B", 200, _payload(20.0, 50, 2.0, 800))],
                               "city string, status int, payload string")
    r = forecast_day_context(weather_context(parse_weather(df)), "2025-03-22").first()
    assert r.next_dow == 5 and r.next_season == "Summer" and r.next_festive == 0
    assert r.next_traffic == pytest.approx(0.98) and r.city_temps == {"A": 30.0, "B": 20.0}
