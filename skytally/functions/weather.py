"""Wind, temperature and heading derived from reported speeds, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed limits and constants of the formulas.
MAX_WIND_KT = 250.0
MIN_MACH = 0.395
SOUND_SPEED_KT = 661.47
STANDARD_TEMPERATURE_K = 288.15
ABSOLUTE_ZERO_C = -273.15
MIN_TEMPERATURE_C, MAX_TEMPERATURE_C = -80.0, 100.0
RECOVERY = 0.2
MAX_CRAB_DEGREES = 45.0


def wind(heading: Column, track: Column, tas: Column, ground_speed: Column) -> Column:
    """``struct<speed:double,direction:double>``; null from 250 kt on or if an input is null."""
    # cos and sin have period 360, so the crab angle needs no folding.
    crab = (heading - track) * math.pi / 180.0
    head = tas - F.cos(crab) * ground_speed
    cross = F.sin(crab) * ground_speed
    speed = F.sqrt(head * head + cross * cross)
    direction = (heading * math.pi / 180.0 + F.atan2(cross, head)) * 180.0 / math.pi
    direction = F.pmod(direction, F.lit(360.0))
    return F.when(speed < MAX_WIND_KT, F.struct(speed.alias("speed"), direction.alias("direction")))


def outside_air_temperature(tas: Column, mach: Column) -> Column:
    """Static air temperature in Celsius, null below Mach 0.395 or outside -80..100."""
    ratio = F.try_divide(tas, SOUND_SPEED_KT * mach)
    celsius = ratio * ratio * STANDARD_TEMPERATURE_K + ABSOLUTE_ZERO_C
    return F.when((mach >= MIN_MACH) & celsius.between(MIN_TEMPERATURE_C, MAX_TEMPERATURE_C), celsius)


def total_air_temperature(oat: Column, mach: Column) -> Column:
    celsius = (oat - ABSOLUTE_ZERO_C) * (1.0 + RECOVERY * mach * mach) + ABSOLUTE_ZERO_C
    return F.when((mach >= MIN_MACH) & celsius.between(MIN_TEMPERATURE_C, MAX_TEMPERATURE_C), celsius)


def true_heading(magnetic: Column, declination: Column, track: Column) -> Column:
    """Magnetic heading plus declination; null if 45 degrees or more off a known track."""
    heading = (magnetic + declination + 360.0) % 360.0
    # A difference already within 180 degrees is left exactly as it is.
    diff = heading - track
    folded = F.when(diff > 180.0, diff - 360.0).when(diff < -180.0, diff + 360.0).otherwise(diff)
    return F.when(track.isNull() | (F.abs(folded) < MAX_CRAB_DEGREES), heading)


def with_declination(df: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon",
                     ts: str = "ts") -> DataFrame:
    """Attach ``declination`` from a grid of one-degree cells per year.

    The grid has at most 180 x 360 rows per year (``cell_lat``, ``cell_lon``, ``year``,
    ``declination``). One year is 64,800 rows, small enough to broadcast whatever the
    size of ``df``; the join is left to the planner so that a grid of many years falls
    back to a shuffle by itself.
    """
    keyed = df.withColumns({
        "_cell_lat": F.floor(F.col(lat)).cast("int"),
        "_cell_lon": F.floor(F.col(lon)).cast("int"),
        "_year": F.year(ts),
    })
    cells = grid.select(
        F.col("cell_lat").alias("_cell_lat"), F.col("cell_lon").alias("_cell_lon"),
        F.col("year").alias("_year"), "declination",
    )
    return keyed.join(cells, ["_cell_lat", "_cell_lon", "_year"], "left").drop("_cell_lat", "_cell_lon", "_year")
