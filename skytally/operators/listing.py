"""Queries over tracks: lists, boxes, search, ranking, outline, statistics, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytally.functions.geo import bearing, distance_mi, distance_nm, map_distance_km
from skytally.functions.units import dbfs
from skytally.operators.folds import interval_micros
from skytally.operators.history import collapse_changes
from skytally.operators.ordered import as_list, micros

SECTIONS = ("identification", "database_record", "status", "position", "velocity_and_dynamics", "autopilot",
            "meteorology", "acas", "capabilities", "data_quality")

LIST_COLUMNS = {
    "icao": "icao", "callsign": "identification.callsign", "squawk": "identification.squawk",
    "category": "identification.category", "lat": "position.lat", "lon": "position.lon",
    "baro_altitude_ft": "position.baro_ft", "geo_altitude_ft": "position.geo_ft", "on_ground": "position.on_ground",
    "speed_kt": "velocity.speed_kt", "track": "velocity.track", "ground_speed_kt": "velocity.ground_speed_kt",
    "ground_track": "velocity.ground_track", "vertical_rate": "velocity.vertical_rate",
    "total_messages": "status.total_messages", "last_seen": "status.last_seen",
}
REGISTRY_COLUMNS = {"registration": "string", "type_code": "string", "operator_name": "string",
                    "military": "boolean", "ladd": "boolean", "pia": "boolean"}


RECORD_FIELDS = ("registration", "country", "type_code", "type_description", "type_icao_class", "model", "manufacturer_icao",
                 "manufacturer_name", "operator_name", "pia", "ladd", "military")
#: Sections made of several structs of the state.
COMPOSED = {"velocity_and_dynamics": ("velocity", "dynamics")}


def section_fields(state: DataFrame, section: str) -> dict[str, str]:
    """Fields of a section of a state table as SQL paths; empty if the state has none of its inputs.

    The registry is a struct ``database_record`` or the columns that ``enrich`` adds.
    """
    structs = COMPOSED.get(section, (section,))
    if all(s in state.columns for s in structs):
        return {f: f"`{s}`.`{f}`" for s in structs for f in state.schema[s].dataType.names}
    if section == "database_record":
        return {f: f"`{f}`" for f in RECORD_FIELDS if f in state.columns}
    return {}


def aircraft_list(state: DataFrame) -> DataFrame:
    """The summary of a state table (nested or already flat): 23 fields, the coordinate as two columns."""
    nested = "identification" in state.columns
    out = [F.col(path if nested else name).alias(name) for name, path in LIST_COLUMNS.items()]
    signal = F.col("status.signal" if nested else "signal")
    out.insert(14, dbfs(signal).alias("signal_db"))
    has = set(state.columns)
    out.append(F.lit(bool(has & set(REGISTRY_COLUMNS))).alias("database_enabled"))
    out += [(F.col(c) if c in has else F.lit(None).cast(t)).alias(c) for c, t in REGISTRY_COLUMNS.items()]
    return state.select(*out)


def check_bounds(south, west, north, east) -> tuple[float, float, float, float]:
    """Numbers of a box; wrong ones raise ``ValueError``."""
    try:
        south, west, north, east = (float(v) for v in (south, west, north, east))
    except (TypeError, ValueError):
        raise ValueError("bounds must be four numbers") from None
    if south >= north:
        raise ValueError(f"south ({south}) must be less than north ({north})")
    if south < -90 or north > 90:
        raise ValueError("latitude must be between -90 and 90")
    if west < -180 or east > 180:
        raise ValueError("longitude must be between -180 and 180")
    return south, west, north, east


def within_bounds(df: DataFrame, south, west, north, east, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows inside a box, edges included; rows without a position are left out."""
    south, west, north, east = check_bounds(south, west, north, east)
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def _contains_any(columns, text: str) -> Column:
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(column)), needle), F.lit(False))
    return hit


def search(df: DataFrame, text: str, columns=("icao", "callsign", "squawk", "registration"), bounds=None) -> DataFrame:
    """Case-insensitive substring in any of the columns; the text is trimmed. Not with a box."""
    if bounds is not None:
        raise ValueError("bounds and search exclude each other")
    return df.where(_contains_any(columns, text.strip()))


def search_short(df: DataFrame, text: str, columns=("icao", "callsign")) -> DataFrame:
    """Case-insensitive substring in address or callsign, the text as given; empty text keeps all."""
    return df.where(_contains_any(columns, text)) if text else df


def detail(state: DataFrame, icao: str | None = None, sections=None) -> DataFrame:
    """Tracks (one, or all without ``icao``) with the chosen sections; no choice and an empty one mean all.

    A section is null if nothing in it is known. An unknown section is an error, and so is one asked for by
    name that the state has no inputs for; among all sections such a one is null.
    """
    if icao is not None and not (len(icao) == 6 and all(c in "0123456789abcdefABCDEF" for c in icao)):
        raise ValueError(f"invalid address: {icao}")
    names = {s.replace("_", ""): s for s in SECTIONS}
    wanted = set()
    for section in (sections or "").split(",") if isinstance(sections or "", str) else sections:
        if not section.strip():
            continue
        plain = section.strip().lower().replace("_", "")
        if plain not in names:
            raise ValueError(f"unknown section: {section}")
        wanted.add(names[plain])
    out = []
    for section in [s for s in SECTIONS if s in wanted] if wanted else SECTIONS:
        fields = section_fields(state, section)
        if not fields and section in wanted:
            raise ValueError(f"the state has no inputs for section {section}")
        if not fields:
            out.append(F.lit(None).cast("string").alias(section))
            continue
        known = F.coalesce(*[F.expr(path).cast("string") for path in fields.values()]).isNotNull()
        out.append(F.when(known, F.struct(*[F.expr(path).alias(f) for f, path in fields.items()])).alias(section))
    rows = state if icao is None else state.where(F.col("icao") == icao.upper())
    return rows.select("icao", *out)


def rank(df: DataFrame, column: str, descending: bool = False, tie: str = "icao") -> DataFrame:
    """Order by a column, unknown values last in both directions, ties by address.

    Text is compared without regard to case.
    """
    value = F.col(column)
    if df.schema[column].dataType.simpleString() == "string":
        value = F.lower(value)
    return df.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col(tie).asc())


def with_distance(df: DataFrame, receiver_lat, receiver_lon, lat="lat", lon="lon", name="distance_mi") -> DataFrame:
    return df.withColumn(name, distance_mi(receiver_lat, receiver_lon, F.col(lat), F.col(lon)))


def rank_web(df: DataFrame, column: str, descending: bool = False, receiver=None, tie: str = "icao", lat="lat",
             lon="lon") -> DataFrame:
    """As ``rank``, only rows with a position, with the map's distance in km (null without receiver)."""
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    distance = map_distance_km(*receiver, F.col(lat), F.col(lon)) if receiver else F.lit(None).cast("double")
    return rank(rows.withColumn("distance_km", distance), column, descending, tie)


def page(df: DataFrame, start: int, n: int) -> DataFrame:
    """``n`` rows of a ranked list from row ``start``; planned as a top-k."""
    return df.offset(start).limit(n)


def in_sectors(df: DataFrame, receiver_lat: float, receiver_lon: float, ts: str, at: Column, sector: int, max_nm: float, retain, lat="lat",
               lon="lon") -> DataFrame:
    """Positions within the trailing window and distance, with ``_nm``, ``_bearing`` and ``_sector``."""
    limit = interval_micros(df.sparkSession, retain)
    age = micros(at) - micros(ts)
    rows = df.where(F.col(lat).isNotNull() & (age >= 0) & (age <= limit)).withColumns({
        "_nm": distance_nm(receiver_lat, receiver_lon, F.col(lat), F.col(lon)),
        "_bearing": bearing(receiver_lat, receiver_lon, F.col(lat), F.col(lon)),
    }).where(F.col("_nm") <= max_nm)
    return rows.withColumn("_sector", F.expr(f"cast(floor(_bearing / {sector}) % {360 // sector} as int)"))


def outline_candidates(rows: DataFrame, ts: str, bucket="1 minute") -> DataFrame:
    """Of positions ``in_sectors`` those that are or may still become the farthest of their sector as the window moves on.

    A position goes when a newer one of its sector is farther. Maxima per sector and ``bucket`` are combined before the
    shuffle and take out nearly all of them, so that a window sees only what is left of one bucket of a sector.
    """
    width = interval_micros(rows.sparkSession, bucket)
    rows = rows.withColumn("_bucket", F.floor(micros(ts) / width))
    newer = Window.partitionBy("_sector").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    later = rows.groupBy("_sector", "_bucket").agg(F.max("_nm").alias("_most")).withColumn("_later", F.max("_most").over(newer))
    left = rows.join(later.drop("_most"), ["_sector", "_bucket"]).where("_later IS NULL OR _nm >= _later")
    within = Window.partitionBy("_sector", "_bucket").orderBy(micros(ts)).rangeBetween(1, Window.unboundedFollowing)
    left = left.withColumn("_later", F.max("_nm").over(within)).where("_later IS NULL OR _nm >= _later")
    return left.drop("_bucket", "_later")


def range_outline(df: DataFrame, receiver_lat: float, receiver_lon: float, ts: str, at: Column, sector: int = 5,
                  max_nm: float = 300.0, retain="4 hours", lat="lat", lon="lon") -> DataFrame:
    """Farthest position per bearing sector in the trailing window, ordered by sector.

    Empty if fewer than three sectors have a position. The aggregation is combined before
    the shuffle, which carries at most one row per sector and task.
    """
    rows = in_sectors(df, receiver_lat, receiver_lon, ts, at, sector, max_nm, retain, lat, lon)
    point = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col("_nm").alias("nm"), F.col(ts).alias("seen_at"))
    # Of equally far positions the first stays.
    farthest = F.max_by(point, F.struct(F.col("_nm"), -micros(ts)))
    best = rows.groupBy(F.col("_sector").alias("sector")).agg(farthest.alias("_p"))
    best = best.withColumn("_sectors", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    return best.where("_sectors >= 3").select("sector", "_p.*").orderBy("sector")


def stream_stats(df: DataFrame, ts: str, valid: Column) -> DataFrame:
    """Total, valid, errors, valid per second and uptime; zeros for no rows."""
    out = df.agg(F.count(F.lit(1)).alias("total_frames"), F.count_if(valid).alias("valid_frames"),
                 F.coalesce((F.max(micros(ts)) - F.min(micros(ts))) / 1e6, F.lit(0.0)).alias("uptime_seconds"))
    rate = F.when(F.col("uptime_seconds") > 0, F.bround(F.col("valid_frames") / F.col("uptime_seconds"), 1))
    return out.withColumns({"errors": F.col("total_frames") - F.col("valid_frames"),
                            "frames_per_second": rate.otherwise(F.lit(0.0))})


def health(df: DataFrame, key, ts: str, at: Column, timeout="60 seconds") -> DataFrame:
    """Active keys at a time and whole seconds since the first row."""
    limit = interval_micros(df.sparkSession, timeout)
    past = df.where(F.col(ts) <= at)
    last = past.groupBy(*as_list(key)).agg(F.max(micros(ts)).alias("_last"), F.min(micros(ts)).alias("_first"))
    return last.agg(
        F.count_if(micros(at) - F.col("_last") <= limit).alias("active"),
        F.floor((micros(at) - F.min("_first")) / 1e6).alias("uptime_seconds"),
    ).selectExpr("'OK' AS status", "active", "uptime_seconds")


def bbox(df: DataFrame, lat="lat", lon="lon") -> DataFrame:
    """Extent of all positions."""
    return df.where(F.col(lat).isNotNull()).agg(
        F.min(lat).alias("south"), F.min(lon).alias("west"), F.max(lat).alias("north"), F.max(lon).alias("east"))


def changed_only(df: DataFrame, key, order, ignore=()) -> DataFrame:
    """Rows whose content differs from that of the key's row before.

    Rows are compared by a 64-bit hash of all columns but the key, the order and ``ignore``.
    """
    skip = {*as_list(key), *as_list(order), *as_list(ignore)}
    content = [c for c in df.columns if c not in skip and not c.startswith("_slice__")]
    hashed = df.withColumn("_content", F.xxhash64(F.struct(*content)))
    return collapse_changes(hashed, key, order, ["_content"]).drop("_content")


def viewport_diff(previous: DataFrame, current: DataFrame, key: str = "icao", pinned=None) -> DataFrame:
    """``entered``, ``changed`` and ``left`` between two snapshots; a pinned key never leaves.

    Both snapshots have one row per key, so the join has no skew.
    """
    content = [c for c in current.columns if c != key]
    before = previous.select(key, F.xxhash64(F.struct(*content)).alias("_before"))
    now = current.withColumn("_now", F.xxhash64(F.struct(*content)))
    both = now.join(before, key, "full_outer")
    event = (F.when(F.col("_before").isNull(), "entered").when(F.col("_now").isNull(), "left")
             .when(F.col("_before") != F.col("_now"), "changed"))
    out = both.withColumn("event", event).where("event IS NOT NULL").drop("_before", "_now")
    if pinned is not None:
        out = out.where((F.col("event") != "left") | (F.col(key) != F.lit(pinned)))
    return out


def windowed_rates(df: DataFrame, ts: str, width: str, slide: str | None = None, valid: Column | None = None) -> DataFrame:
    """Frames and frames per second in tumbling or sliding windows."""
    window = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    seconds = interval_micros(df.sparkSession, width) / 1e6
    out = df.groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("total_frames"),
        (F.count_if(valid) if valid is not None else F.count(F.lit(1))).alias("valid_frames"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_frames",
                      "valid_frames", (F.col("valid_frames") / seconds).alias("frames_per_second"))
