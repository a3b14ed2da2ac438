"""Derived weather per aircraft: wind and temperature from Comm-B reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.functions.weather import outside_air_temperature, total_air_temperature, true_heading, wind, with_declination
from skytally.operators.aircraft import KEY, ORDER, SECTION_RULES, TRACK
from skytally.operators.folds import rate_limit
from skytally.operators.ordered import micros
from skytally.operators.tracks import keep_known, overwrite, state_as_of

MAX_HEADING_AGE_US = 1_250_000
MAX_SPEED_AGE_US = 2_500_000


def derived_weather(df: DataFrame, key, ts: str, order, every: str = "1 second", session: str | None = None) -> DataFrame:
    """Weather state after every row.

    Input columns, all as known after the row: ``on_ground``, ``true_heading``, ``track``,
    ``tas``, ``gs``, ``mach``, the times ``dynamics_ts`` (heading and Mach) and
    ``velocity_ts`` (speeds and track). ``computes`` marks rows after which wind and
    temperature are computed, ``reports`` rows that bring weather themselves as
    ``report_wind_speed``, ``report_wind_direction`` and ``report_temperature``.

    Headings and track must be at most 1.25 s old, speeds and Mach 2.5 s. A computed value
    is taken at most once per ``every``, counted from the last change of any kind.
    """
    now = micros(ts)

    def fresh(column, limit):
        return F.coalesce(now - micros(column) <= limit, F.lit(False))

    airborne = ~F.coalesce(F.col("on_ground"), F.lit(False))
    wind_ok = airborne & fresh("dynamics_ts", MAX_HEADING_AGE_US) & fresh("velocity_ts", MAX_HEADING_AGE_US)
    heat_ok = airborne & fresh("dynamics_ts", MAX_SPEED_AGE_US) & fresh("velocity_ts", MAX_SPEED_AGE_US)
    out = df.withColumns({
        "_wind": F.when(wind_ok, wind(F.col("true_heading"), F.col("track"), F.col("tas"), F.col("gs"))),
        "_oat": F.when(heat_ok, outside_air_temperature(F.col("tas"), F.col("mach"))),
    })
    out = out.withColumns({
        "_speed": F.rint(F.col("_wind.speed")).cast("int"),
        "_direction": F.col("_wind.direction"),
        "_tat": total_air_temperature(F.col("_oat"), F.col("mach")),
    }).drop("_wind")
    out = out.withColumn("_may", F.expr("computes AND (_speed IS NOT NULL OR _oat IS NOT NULL)"))
    out = rate_limit(out, key, ts, every, order, eligible="_may", forced="reports", output="weather_changed")
    computed = "weather_changed AND NOT coalesce(reports, false)"
    rules = [
        keep_known("wind_speed", f"CASE WHEN reports THEN report_wind_speed WHEN {computed} THEN _speed END"),
        keep_known("wind_direction", f"CASE WHEN reports THEN report_wind_direction WHEN {computed} THEN _direction END"),
        keep_known("static_temperature", f"CASE WHEN reports THEN report_temperature WHEN {computed} THEN _oat END"),
        keep_known("total_temperature", f"CASE WHEN {computed} THEN _tat END"),
    ]
    return state_as_of(out, key, order, rules, session).drop("_speed", "_direction", "_oat", "_tat", "_may")


NEEDED = {"track_angle", "track", "commb_tas_kt", "commb_gs_kt", "speed_kt", "velocity_ts", "magnetic_heading", "mach", "dynamics_ts", "on_ground"}


def track_weather(messages: DataFrame, positions: DataFrame, grid: DataFrame, every: str = "1 second") -> DataFrame:
    """Weather and true heading of every track after every message.

    The true heading follows from the magnetic one of registers 5,3 and 6,0 and the declination (``grid`` of cells
    and years) at the track's position; it stays as it was where the track contradicts it or no position is known.
    Wind and temperatures are those of ``derived_weather``, which this heading enters.
    """
    slices = [c for c in messages.columns if c.startswith("_slice__")]
    rows = messages.select(*TRACK, *ORDER, "msg_type", "bds", *slices, "airborne_position", "surface_position", "velocity",
                           "bds_44", "bds_45", "bds_50", "bds_53", "bds_60")
    fixes = positions.select(KEY, "frame_id", F.struct("track_lat", "track_lon").alias("fix"))
    rules = [r for section in ("velocity", "dynamics", "position") for r in SECTION_RULES[section] if r.name in NEEDED]
    out = state_as_of(rows.join(fixes, [KEY, "frame_id"], "left"), KEY, ORDER, [*rules, overwrite("_fix", "fix", "fix IS NOT NULL")], "session")
    out = out.selectExpr(
        *TRACK, *ORDER, *[f"`{c}`" for c in slices], "on_ground", "magnetic_heading", "coalesce(track_angle, track) AS track",
        "cast(commb_tas_kt as double) AS tas", "cast(coalesce(commb_gs_kt, speed_kt) as double) AS gs", "mach", "dynamics_ts", "velocity_ts",
        "coalesce(bds IN ('5,0', '5,3', '6,0'), false) AS computes", "coalesce(bds IN ('4,4', '4,5'), false) AS reports",
        "bds_44.wind_speed_kt AS report_wind_speed", "bds_44.wind_direction AS report_wind_direction",
        "coalesce(bds_44.temperature, bds_45.temperature) AS report_temperature", "coalesce(bds IN ('5,3', '6,0'), false) AS _turns",
        "_fix.track_lat AS lat", "_fix.track_lon AS lon")
    out = with_declination(out, grid).withColumn("_declination", F.expr("CASE WHEN _turns AND magnetic_heading IS NOT NULL THEN declination END"))
    out = out.withColumn("_heading", true_heading(F.col("magnetic_heading"), F.col("_declination"), F.col("track"))).drop("declination")
    known = [keep_known("true_heading", "_heading"), keep_known("magnetic_declination", "_declination")]
    out = state_as_of(out, KEY, ORDER, known, "session").drop("_heading", "_declination", "_turns")
    return derived_weather(out, KEY, "ts", ORDER, every, "session")
