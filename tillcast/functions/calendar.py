"""Calendar, season, festive and traffic columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillcast.functions.numeric import col_

# ---- fixed values (must equal the reference's for equal results) ----------
# Season of a month: 3-5 Summer, 6-9 SouthWest_Monsoon, 10-11 NorthEast_Monsoon,
# every other month Winter. Season codes: Winter 0, Summer 1,
# SouthWest_Monsoon 2, NorthEast_Monsoon 3.
SEASON_CODES = {"Winter": 0, "Summer": 1, "SouthWest_Monsoon": 2, "NorthEast_Monsoon": 3}
# Festive windows as (month, first day, last day); the last day is capped at 31.
FESTIVE_WINDOWS = [(1, 13, 17), (4, 13, 15), (8, 25, 35), (10, 20, 31), (11, 1, 10), (12, 23, 31)]
# Traffic index by day of week, Monday=0 .. Sunday=6; default 0.60; +0.10 when
# raining; capped at 1.0.
TRAFFIC_BASE = [0.78, 0.75, 0.58, 0.55, 0.70, 0.88, 0.85]
TRAFFIC_DEFAULT, TRAFFIC_RAIN = 0.60, 0.10
# Delivery delay index by day of week, Monday=0 .. Sunday=6; default 0.25;
# +0.20 when raining; capped at 1.0.
DELAY_BASE = [0.30, 0.25, 0.20, 0.20, 0.35, 0.50, 0.45]
DELAY_DEFAULT, DELAY_RAIN = 0.25, 0.20
# ---------------------------------------------------------------------------


def weekday(dt) -> Column:
    """Monday=0 .. Sunday=6 (Spark's dayofweek is Sunday=1)."""
    return F.weekday(col_(dt))


def season_name(month) -> Column:
    m = col_(month)
    return (F.when(m.between(3, 5), "Summer")
            .when(m.between(6, 9), "SouthWest_Monsoon")
            .when(m.between(10, 11), "NorthEast_Monsoon")
            .otherwise("Winter"))


def season_code(month) -> Column:
    m = col_(month)
    return (F.when(m.between(3, 5), 1)
            .when(m.between(6, 9), 2)
            .when(m.between(10, 11), 3)
            .otherwise(0))


def is_festive(month, day) -> Column:
    m, d = col_(month), col_(day)
    cond = F.lit(False)
    for mm, d1, d2 in FESTIVE_WINDOWS:
        cond = cond | ((m == mm) & d.between(d1, min(d2, 31)))
    return cond.cast("int")


def _dow_lookup(dow, table: list[float], default: float) -> Column:
    d = col_(dow)
    out = None
    for i, v in enumerate(table):
        out = F.when(d == i, F.lit(v)) if out is None else out.when(d == i, F.lit(v))
    return out.otherwise(F.lit(default))


def traffic_index(dow, rainy) -> Column:
    bump = F.when(col_(rainy) == 1, TRAFFIC_RAIN).otherwise(0.0)
    return F.least(_dow_lookup(dow, TRAFFIC_BASE, TRAFFIC_DEFAULT) + bump, F.lit(1.0))


def delay_index(dow, rainy) -> Column:
    bump = F.when(col_(rainy) == 1, DELAY_RAIN).otherwise(0.0)
    return F.least(_dow_lookup(dow, DELAY_BASE, DELAY_DEFAULT) + bump, F.lit(1.0))


def heat_index(temp, humidity) -> Column:
    """t + 0.33 * (h/100 * 6.105 * exp(17.27 t / (237.7 + t))) - 4."""
    t, h = col_(temp), col_(humidity)
    return t + 0.33 * (h / 100.0 * 6.105 * F.exp((17.27 * t) / (237.7 + t))) - 4.0


def cyclic(x, period: int):
    """(sin, cos) of 2*pi*x/period."""
    a = F.lit(2 * math.pi) * col_(x) / F.lit(float(period))
    return F.sin(a), F.cos(a)


def parse_dayfirst(c) -> Column:
    """Day-first date text or a timestamp -> timestamp (no-op on timestamps)."""
    s = F.trim(col_(c).cast("string"))
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("dd/MM/yyyy")),
        F.try_to_timestamp(s, F.lit("dd-MM-yyyy")),
        F.try_to_timestamp(s, F.lit("dd/MM/yyyy HH:mm:ss")),
        F.try_to_timestamp(s),
    )
