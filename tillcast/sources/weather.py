"""Weather payloads landed as JSON records (one per city) -> scalar context.

The reference calls a weather service per city at run time; here the raw
responses are a landed table ``(city, status, payload)`` and parsing is a
``from_json`` over it. A record whose status is not 200, whose body does not
parse or lacks a required field gives NULL in all five fields.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.calendar import heat_index
from tillcast.sources.schemas import WEATHER_PAYLOAD, WEATHER_RECORD

# Defaults when no city reports a value (fixed values).
DEFAULT_TEMP, DEFAULT_HUMIDITY, DEFAULT_WIND, DEFAULT_RAIN = 30.0, 68.0, 5.0, 0.0
# A weather condition id below this value means rain (fixed value).
RAIN_ID_LIMIT = 700

FIXTURE = os.path.join(os.path.dirname(__file__), "..", "..", "fixtures", "weather_payloads.jsonl")


def read_weather(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Scan landed weather records (JSON lines with city, status, payload) from
    any path Spark reads; without one, from ``tillcast.weather.path`` or, in
    local mode, the fixture."""
    path = path or spark.conf.get("tillcast.weather.path", None)
    if path is None:
        # two small records: the driver hands them over, executors need no file
        with open(os.path.abspath(FIXTURE), encoding="utf-8") as f:
            lines = [(line,) for line in f if line.strip()]
        record = F.from_json("line", WEATHER_RECORD)
        return spark.createDataFrame(lines, "line string").select(record.alias("r")).select("r.*")
    return spark.read.schema(WEATHER_RECORD).json(path)


def parse_weather(records: DataFrame) -> DataFrame:
    """city, temp, humidity, wind, rain_1h, is_rainy per record (S3)."""
    j = F.from_json(F.col("payload"), WEATHER_PAYLOAD, {"mode": "PERMISSIVE"})
    p = records.select("city", "status", j.alias("j"))
    first_id = F.element_at(F.col("j.weather"), 1).getField("id")
    ok = ((F.col("status") == 200) & F.col("j.main.temp").isNotNull()
          & F.col("j.main.humidity").isNotNull() & F.col("j.wind.speed").isNotNull()
          & first_id.isNotNull())

    def keep(c):
        return F.when(ok, c)

    return p.select(
        "city",
        keep(F.col("j.main.temp")).alias("temp"),
        keep(F.col("j.main.humidity")).alias("humidity"),
        keep(F.col("j.wind.speed")).alias("wind"),
        keep(F.coalesce(F.element_at(F.col("j.rain"), F.lit("1h")), F.lit(0.0))).alias("rain_1h"),
        keep((first_id < RAIN_ID_LIMIT).cast("int")).alias("is_rainy"),
    )


def weather_context(parsed: DataFrame) -> DataFrame:
    """One row: city means with defaults, rain flag OR-ed, heat index.
    Only the last record of each city counts (the largest, where the landing has
    no order of its own), so a repeated city cannot break the map of cities."""
    fields = [c for c in parsed.columns if c != "city"]
    last = parsed.groupBy("city").agg(F.max(F.struct(*fields)).alias("_r"))
    agg = last.select("city", *[F.col(f"_r.{c}").alias(c) for c in fields]).agg(
        F.coalesce(F.avg("temp"), F.lit(DEFAULT_TEMP)).alias("temperature"),
        F.coalesce(F.avg("humidity"), F.lit(DEFAULT_HUMIDITY)).alias("humidity"),
        F.coalesce(F.avg("wind"), F.lit(DEFAULT_WIND)).alias("wind_speed"),
        F.coalesce(F.avg("rain_1h"), F.lit(DEFAULT_RAIN)).alias("rain_1h"),
        F.coalesce(F.max("is_rainy"), F.lit(0)).cast("int").alias("is_rainy"),
        F.map_from_entries(F.collect_list(F.struct("city", "temp"))).alias("city_temps"),
    )
    return agg.withColumn("heat_index", heat_index("temperature", "humidity"))
