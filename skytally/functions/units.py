"""Unit conversions, signal level and display classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed conversion factors.
METERS_PER_FOOT = 0.3048
KMH_PER_KNOT = 1.852
MPH_PER_KNOT = 1.15078
MPS_PER_KNOT = 0.514444
KM_PER_NM = 1.852
MILES_PER_KM = 0.621371

# Fixed colour stops per class: altitude in feet, then red, green, blue.
COLOR_STOPS = {
    "normal": [(0, (179, 217, 255)), (10000, (102, 178, 255)), (25000, (51, 153, 255)), (40000, (0, 97, 146))],
    "military": [(0, (179, 230, 179)), (10000, (102, 194, 102)), (25000, (51, 163, 51)), (40000, (0, 110, 0))],
    "privacy": [(0, (255, 179, 179)), (10000, (255, 102, 102)), (25000, (220, 50, 50)), (40000, (160, 0, 0))],
}


def round_half_even(value: Column) -> Column:
    return F.rint(value)


def round_half_up(value: Column) -> Column:
    """Rounding used by the map client: halves go up."""
    return F.floor(value + 0.5)


def feet_to_meters(feet: Column) -> Column:
    return F.rint(feet * METERS_PER_FOOT).cast("int")


def meters_to_feet(meters: Column) -> Column:
    return F.rint(meters / METERS_PER_FOOT).cast("int")


def flight_level(feet: Column) -> Column:
    """Hundreds of feet, truncated toward zero."""
    return (feet / 100).cast("int")


def knots_to_kmh(knots: Column) -> Column:
    return F.rint(knots * KMH_PER_KNOT).cast("int")


def knots_to_mph(knots: Column) -> Column:
    return F.rint(knots * MPH_PER_KNOT).cast("int")


def knots_to_mps(knots: Column) -> Column:
    return knots * MPS_PER_KNOT


def kmh_to_knots(kmh: Column) -> Column:
    return F.rint(kmh / KMH_PER_KNOT).cast("int")


def mph_to_knots(mph: Column) -> Column:
    return F.rint(mph / MPH_PER_KNOT).cast("int")


def km_to_nm(km: Column) -> Column:
    return F.round(km / KM_PER_NM, 1)


def km_to_miles(km: Column) -> Column:
    return F.round(km * MILES_PER_KM, 1)


def dbfs(signal: Column) -> Column:
    """Signal level in dB of full scale; null when there is no signal."""
    return F.when(signal > 0, 10.0 * F.log10(signal / 255.0))


def best_altitude(barometric: Column, geometric: Column) -> Column:
    return F.coalesce(barometric, geometric)


def best_speed(air: Column, ground: Column) -> Column:
    return F.coalesce(air, ground)


def priority_class(military: Column, ladd: Column, pia: Column) -> Column:
    """Military before privacy before normal; unknown flags count as false."""
    return (
        F.when(F.coalesce(military, F.lit(False)), "military")
        .when(F.coalesce(ladd, F.lit(False)) | F.coalesce(pia, F.lit(False)), "privacy")
        .otherwise("normal")
    )


def altitude_band(feet: Column, step: int = 2000, top: int = 40000) -> Column:
    """Lower edge of the altitude band, clamped to 0..``top``."""
    clamped = F.greatest(F.lit(0), F.least(feet, F.lit(top)))
    return (F.floor(clamped / step) * step).cast("int")


def altitude_color(feet: Column, css_class: Column) -> Column:
    """``struct<r,g,b>`` interpolated between the fixed stops of the class."""

    def channel(stops, i):
        out = F.when(feet <= stops[0][0], F.lit(stops[0][1][i]))
        for (low, c_low), (high, c_high) in zip(stops, stops[1:]):
            share = (feet - low) / float(high - low)
            out = out.when(feet <= high, round_half_up(c_low[i] + share * (c_high[i] - c_low[i])).cast("int"))
        return out.when(feet > stops[-1][0], F.lit(stops[-1][1][i]))

    def color(stops):
        return F.struct(*[channel(stops, i).alias(n) for i, n in enumerate("rgb")])

    return (
        F.when(css_class == "military", color(COLOR_STOPS["military"]))
        .when(css_class == "privacy", color(COLOR_STOPS["privacy"]))
        .otherwise(color(COLOR_STOPS["normal"]))
    )
