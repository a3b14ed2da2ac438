"""Change-only histories, paging over them, trails and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.operators.ordered import Previous, RowsAfter, as_list, drop_slices, row_numbers, scan

CAPACITY = 1000
MAX_PAGE = 10_000
KINDS = ("position", "altitude", "velocity", "state")


def collapse_changes(df: DataFrame, key, order, columns) -> DataFrame:
    """Keep a row only if ``columns`` differ from those of the row before, nulls equal to nulls."""
    current = F.struct(*[F.col(c) for c in as_list(columns)])
    out = scan(df, key, order, _before=Previous(current))
    return out.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(current)).drop("_before")


def with_seq(df: DataFrame, key, order, name: str = "seq") -> DataFrame:
    """Sequence number per key, from 1."""
    return scan(df, key, order, **{name: row_numbers()})


def cap_history(df: DataFrame, key, order, n: int = CAPACITY) -> DataFrame:
    """Newest ``n`` rows per key, with the numbers they have."""
    return scan(df, key, order, _after=RowsAfter()).where(F.col("_after") < n).drop("_after")


def change_history(df: DataFrame, key, order, columns, n: int | None = None) -> DataFrame:
    """Changes of ``columns``, numbered, newest ``n`` per key."""
    out = with_seq(collapse_changes(df, key, order, columns), key, order)
    return out if n is None else cap_history(out, key, order, n)


def _of_kind(df: DataFrame, key, order, kind: str, known: str, changed, kept, n) -> DataFrame:
    rows = change_history(df.where(known), key, order, changed, n)
    return drop_slices(rows.withColumn("kind", F.lit(kind))).select(
        *as_list(key), "kind", "seq", *as_list(order), *kept)


def position_history(df: DataFrame, key, order, n: int | None = None) -> DataFrame:
    """Coordinate and accuracy once a position is known; judged on the coordinate."""
    return _of_kind(df, key, order, "position", "lat IS NOT NULL", ["lat", "lon"], ["lat", "lon", "nac_p"], n)


def altitude_history(df: DataFrame, key, order, n: int | None = None) -> DataFrame:
    """Barometric altitude if known, else geometric; judged on value and type."""
    rows = df.withColumns({
        "altitude_ft": F.expr("coalesce(baro_ft, geo_ft)"),
        "altitude_type": F.expr("CASE WHEN baro_ft IS NOT NULL THEN 'Barometric' WHEN geo_ft IS NOT NULL THEN 'Geometric' END"),
    })
    columns = ["altitude_ft", "altitude_type"]
    return _of_kind(rows, key, order, "altitude", "altitude_ft IS NOT NULL", columns, columns, n)


VELOCITY_COLUMNS = ["speed_kt", "heading", "track", "ground_speed_kt", "ground_track", "vertical_rate"]


def velocity_history(df: DataFrame, key, order, n: int | None = None) -> DataFrame:
    """Speeds, directions and climb; the subtype is kept but not compared."""
    return _of_kind(df, key, order, "velocity", "speed_kt IS NOT NULL OR ground_speed_kt IS NOT NULL",
                    [*VELOCITY_COLUMNS, "speed_type"], [*VELOCITY_COLUMNS, "speed_type", "velocity_subtype"], n)


def state_history(df: DataFrame, key, order, n: int | None = None) -> DataFrame:
    """Position, altitude and velocity in one row; judged on the coordinate."""
    rows = df.withColumns({
        "altitude_ft": F.expr("coalesce(baro_ft, geo_ft)"),
        "altitude_type": F.expr("CASE WHEN baro_ft IS NOT NULL THEN 'Barometric' WHEN geo_ft IS NOT NULL THEN 'Geometric' END"),
    })
    kept = ["lat", "lon", "nac_p", "altitude_ft", "altitude_type", *VELOCITY_COLUMNS]
    return _of_kind(rows, key, order, "state", "lat IS NOT NULL", ["lat", "lon"], kept, n)


def history_page(df: DataFrame, key, order, kind: str | None = None, limit=None, after=None) -> DataFrame:
    """Newest ``limit`` rows (at most 10,000) per key, or all rows with a number above ``after``.

    ``after`` wins over ``limit`` and needs a kind. Wrong arguments raise ``ValueError``.
    """
    if kind is not None and kind.lower() not in KINDS:
        raise ValueError(f"unknown history kind: {kind}")
    if limit is not None:
        limit = _number("limit", limit)
        if limit <= 0:
            raise ValueError(f"limit must be positive: {limit}")
        limit = min(limit, MAX_PAGE)
    if after is not None:
        after = _number("after", after)
        if after < 0:
            raise ValueError(f"after must not be negative: {after}")
        if kind is None:
            raise ValueError("after needs a history kind")
    rows = df if kind is None else df.where(F.col("kind") == kind.lower())
    if after is not None:
        return rows.where(F.col("seq") > after)
    if limit is not None:
        keys = as_list(key) + (["kind"] if "kind" in df.columns and kind is None else [])
        return cap_history(rows, keys, order, limit)
    return rows


def _number(name: str, value) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be an integer: {value}") from None


def history_meta(df: DataFrame, key, capacity: int = CAPACITY) -> DataFrame:
    """Capacity, count, lowest and highest sequence number per key."""
    return df.groupBy(*as_list(key)).agg(
        F.lit(capacity).alias("capacity"), F.count(F.lit(1)).alias("n_entries"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def trail(df: DataFrame, key, order, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points of a line per key, numbered in order, repeated points dropped.

    One row per point: a long track stays spread over rows instead of one array.
    """
    points = collapse_changes(df.where(F.col(lat).isNotNull()), key, order, [lat, lon])
    return drop_slices(with_seq(points, key, order, "point").select(
        *as_list(key), *[c for c in points.columns if c.startswith("_slice__")], "point", lat, lon))


def profile_range(df: DataFrame, value: str, keys=(), ticks: int = 6, from_zero: bool = False) -> DataFrame:
    """Axis bounds for a profile: smallest 1-2-5 step whose ``ticks`` marks cover the values."""
    out = df.groupBy(*as_list(keys)).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    if from_zero:
        out = out.withColumn("_lo", F.least(F.col("_lo"), F.lit(0.0)))
    gaps = ticks - 1
    out = out.selectExpr("* EXCEPT (_lo, _hi)", "CASE WHEN _lo = _hi THEN _lo - 1 ELSE _lo END AS _lo",
                         "CASE WHEN _lo = _hi THEN _hi + 1 ELSE _hi END AS _hi")
    out = out.withColumn("_mag", F.expr(f"pow(10.0D, floor(log10((_hi - _lo) / {gaps})))"))
    steps = [f"greatest(1.0D, _mag * {m})" for m in (1, 2, 5, 10)]
    fits = " ".join(
        f"WHEN floor((ceil(_hi / {s}) * {s} - floor(_lo / {s}) * {s}) / {s} + 0.5D) + 1 <= {ticks} THEN {s}" for s in steps)
    out = out.withColumn("step", F.expr(f"CASE {fits} ELSE {steps[-1]} END"))
    out = out.withColumn("axis_min", F.expr("floor(_lo / step) * step"))
    return out.withColumn("axis_max", F.expr(f"axis_min + step * {gaps}")).drop("_lo", "_hi", "_mag")
