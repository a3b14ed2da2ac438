"""Aircraft state from decoded messages: the merge rule of every field, and the chain to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.operators.decode import classify, decode_messages
from skytally.operators.folds import plausible_track
from skytally.operators.frames import CONFIDENCE_LEVELS, confidence_gate, dedup_within, validate_frames
from skytally.operators.ordered import micros, partition_columns, slice_of, split_hot_keys
from skytally.operators.positions import decode_airborne_cpr, decode_surface_cpr, pair_latest, range_guard
from skytally.operators.stages import cut_lineage
from skytally.operators.tracks import (
    Rule,
    counter_aggregates,
    derive_altitude,
    keep_known,
    latest_state,
    mlat_aggregate,
    overwrite,
    sessionize,
    state_as_of,
)

KEY = "icao_raw"
ORDER = ["ts", "frame_id"]
TRACK = [KEY, "session"]


def _kind(*names: str) -> str:
    return "msg_type IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _register(*codes: str) -> str:
    return "bds IN (" + ", ".join(f"'{c}'" for c in codes) + ")"


def _first(*paths: str) -> str:
    return "coalesce(" + ", ".join(paths) + ")"


IDENT, STATUS, VELOCITY = _kind("identification"), _kind("status"), _kind("velocity")
SURFACE, AIRBORNE, OPERATION = _kind("surface_position"), _kind("airborne_position"), _kind("operational_status")
TARGET, SHORT, LONG = _kind("target_state"), _kind("air_air_short"), _kind("air_air_long")
CLASS, MODE = f"{OPERATION} AND operational_status.has_capability", f"{OPERATION} AND operational_status.has_mode"
CALLSIGN = f"{IDENT} OR ({_register('2,0')} AND bds_20.callsign <> '')"
DYNAMICS = _register("5,0", "5,3", "6,0")
WEATHER = _register("4,4", "4,5")

#: Every field with the rows that touch it, by section. Overwrite takes nulls, keep_known does not.
SECTION_RULES: dict[str, list[Rule]] = {
    "identification": [
        overwrite("callsign", _first("identification.callsign", "bds_20.callsign"), CALLSIGN),
        overwrite("category", "identification.category", IDENT),
        overwrite("squawk", _first("identity_reply.squawk", "status.squawk"),
                  f"{_kind('identity_reply')} OR ({STATUS} AND status.squawk IS NOT NULL)"),
        keep_known("emergency", "status.emergency"),
        overwrite("flight_status",
                  _first("altitude_reply.flight_status", "identity_reply.flight_status", "cast(air_air_short.on_ground as int)"),
                  _kind("altitude_reply", "identity_reply", "air_air_short")),
        overwrite("version", "operational_status.version", OPERATION),
    ],
    "position": [
        overwrite("antenna", "airborne_position.antenna", AIRBORNE),
        overwrite("on_ground", SURFACE, _kind("airborne_position", "surface_position")),
        overwrite("movement", "surface_position.movement", SURFACE),
        overwrite("position_source", "source", _kind("airborne_position", "surface_position")),
        overwrite("nac_p", "operational_status.nac_p", OPERATION),
        keep_known("nic_baro", "operational_status.nic_baro"),
        overwrite("sil", "operational_status.sil", OPERATION),
    ],
    "velocity": [
        overwrite("speed_kt", "velocity.speed_kt", VELOCITY),
        overwrite("speed_type", "velocity.speed_type", VELOCITY),
        overwrite("vertical_rate", "velocity.vertical_rate", VELOCITY),
        overwrite("velocity_subtype", "velocity.subtype", VELOCITY),
        overwrite("nac_v", "velocity.nac_v", VELOCITY),
        overwrite("track", "velocity.track", f"{VELOCITY} AND velocity.subtype IN (1, 2)"),
        overwrite("heading", "velocity.heading", f"{VELOCITY} AND velocity.subtype IN (3, 4)"),
        keep_known("ground_speed_kt", "surface_position.ground_speed_kt"),
        keep_known("ground_track", "surface_position.ground_track"),
        keep_known("track_angle", "bds_50.track_angle"),
        keep_known("commb_tas_kt", _first("bds_50.true_airspeed_kt", "bds_53.true_airspeed_kt")),
        keep_known("commb_gs_kt", "bds_50.ground_speed_kt"),
        keep_known("commb_ias_kt", _first("bds_53.indicated_airspeed_kt", "bds_60.indicated_airspeed_kt")),
        overwrite("velocity_ts", f"CASE WHEN NOT ({VELOCITY}) OR velocity.speed_kt IS NOT NULL THEN ts END",
                  f"{VELOCITY} OR {SURFACE} OR {DYNAMICS}"),
    ],
    "autopilot": [
        keep_known("selected_altitude_ft",
                   _first("target_state.selected_altitude_ft", "bds_40.mcp_altitude_ft", "bds_40.fms_altitude_ft")),
        keep_known("altitude_source", _first(
            "target_state.altitude_source",
            "CASE bds_40.altitude_source WHEN 2 THEN 'MCP/FCU' WHEN 3 THEN 'FMS' WHEN 1 THEN 'Unknown' WHEN 0 THEN NULL ELSE "
            "CASE WHEN bds_40.mcp_altitude_ft IS NOT NULL THEN 'MCP/FCU' WHEN bds_40.fms_altitude_ft IS NOT NULL THEN 'FMS' END END")),
        keep_known("selected_heading", "target_state.selected_heading"),
        keep_known("pressure_mb", _first("target_state.pressure_mb", "bds_40.pressure_mb")),
        keep_known("vertical_mode", "target_state.vertical_mode"),
        keep_known("horizontal_mode", "target_state.horizontal_mode"),
        keep_known("autopilot_engaged", "target_state.autopilot"),
        # A register can only turn these modes on.
        keep_known("vnav", _first("target_state.vnav", "CASE WHEN bds_40.nav_modes & 1 <> 0 THEN true END")),
        keep_known("altitude_hold", _first("target_state.altitude_hold", "CASE WHEN bds_40.nav_modes & 2 <> 0 THEN true END")),
        keep_known("approach", _first("target_state.approach", "CASE WHEN bds_40.nav_modes & 4 <> 0 THEN true END")),
        keep_known("lnav", "target_state.lnav"),
        overwrite("autopilot_ts", "ts", f"{TARGET} OR {_register('4,0')}"),
    ],
    "meteorology": [
        keep_known("wind_speed_kt", "bds_44.wind_speed_kt"),
        keep_known("wind_direction", "bds_44.wind_direction"),
        keep_known("static_temperature", _first("bds_44.temperature", "bds_45.temperature")),
        keep_known("pressure", _first("bds_44.pressure", "bds_45.pressure")),
        keep_known("radio_height_ft", "bds_45.radio_height_ft"),
        keep_known("turbulence", _first("bds_44.turbulence", "bds_45.turbulence")),
        keep_known("wind_shear", "bds_45.wind_shear"),
        keep_known("microburst", "bds_45.microburst"),
        keep_known("icing", "bds_45.icing"),
        keep_known("wake_vortex", "bds_45.wake_vortex"),
        keep_known("humidity", "bds_44.humidity"),
        keep_known("figure_of_merit", "bds_44.figure_of_merit"),
        overwrite("weather_ts", "ts", WEATHER),
    ],
    "acas": [
        keep_known("tcas_operational", "target_state.tcas"),
        overwrite("tcas_ra_active", f"CASE WHEN {LONG} THEN coalesce(NOT air_air_long.ra_terminated, false) ELSE target_state.ra_active END",
                  f"{LONG} OR ({TARGET} AND target_state.ra_active IS NOT NULL)"),
        overwrite("sensitivity", _first("air_air_short.sensitivity", "air_air_long.sensitivity"), f"{SHORT} OR {LONG}"),
        overwrite("cross_link", "air_air_short.cross_link", SHORT),
        overwrite("reply_information", _first("air_air_short.reply_information", "air_air_long.reply_information"),
                  f"{SHORT} OR {LONG}"),
        overwrite("ra_terminated", "air_air_long.ra_terminated", LONG),
        overwrite("multiple_threat", "air_air_long.multiple_threat", LONG),
        overwrite("not_below", "air_air_long.not_below", LONG),
        overwrite("not_above", "air_air_long.not_above", LONG),
        overwrite("not_left", "air_air_long.not_left", LONG),
        overwrite("not_right", "air_air_long.not_right", LONG),
        overwrite("acas_ts", "ts", f"{SHORT} OR {LONG} OR {TARGET}"),
    ],
    "capabilities": [
        overwrite("transponder_level", "all_call.capability", _kind("all_call")),
        *[overwrite(name, f"operational_status.{field}", CLASS) for name, field in (
            ("tcas_capability", "tcas"), ("cockpit_display", "cdti"), ("es1090", "es1090"), ("air_referenced", "arv"),
            ("target_reporting", "ts_report"), ("trajectory_level", "tc_level"), ("uat978", "uat"),
            ("position_offset", "poa"), ("low_power", "b2_low"), ("nac_v_report", "nac_v"), ("nic_c", "nic_c"))],
        keep_known("length_m", "operational_status.length_m"),
        keep_known("width_m", "operational_status.width_m"),
        overwrite("datalink_bits", "bds_10.capability_bits", _register("1,0")),
        overwrite("register_mask", "bds_17.register_mask", _register("1,7")),
        *[overwrite(name, f"operational_status.{field}", MODE) for name, field in (
            ("ra_active_mode", "ra_active"), ("ident_active", "ident"), ("atc_services", "atc"), ("single_antenna", "antenna"),
            ("design_assurance", "sda"), ("gps_lateral_m", "gps_lateral_m"), ("gps_longitudinal_m", "gps_longitudinal_m"))],
        overwrite("downlink_request", "comm_b.downlink_request", _kind("comm_b")),
        overwrite("utility_message", "comm_b.utility_message", _kind("comm_b")),
        overwrite("capabilities_ts", "ts", f"{OPERATION} OR {_kind('all_call')} OR {_register('1,0', '1,7')}"),
    ],
    "data_quality": [
        keep_known("gva", "operational_status.gva"),
        keep_known("nic_a", "operational_status.nic_a"),
        keep_known("sil_supplement", "operational_status.sil_supplement"),
        keep_known("hrd", "operational_status.hrd"),
        keep_known("heading_type", "operational_status.heading_type"),
        keep_known("sil_target", "target_state.sil"),
        keep_known("nac_p_target", "target_state.nac_p"),
        keep_known("nic_baro_target", "target_state.nic_baro"),
        overwrite("quality_ts", "ts", f"{OPERATION} OR {TARGET}"),
    ],
    "dynamics": [
        keep_known("roll", "bds_50.roll"),
        keep_known("track_rate", "bds_50.track_rate"),
        keep_known("magnetic_heading", _first("bds_53.magnetic_heading", "bds_60.magnetic_heading")),
        keep_known("mach", _first("bds_53.mach", "bds_60.mach")),
        keep_known("baro_rate", _first("bds_53.vertical_rate", "bds_60.baro_rate")),
        keep_known("inertial_rate", "bds_60.inertial_rate"),
        overwrite("dynamics_ts", "ts", DYNAMICS),
    ],
}


def received_messages(frames: DataFrame, window="50 milliseconds", confidence: str | int | None = "medium",
                      gate_timeout="30 seconds", track_timeout="60 seconds",
                      rows_per_slice: int | None = None, across_receivers: bool = False, settle: bool = False, rows: int | None = None,
                      sample: Callable[[float], DataFrame] | None = None, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Frames to decoded messages with their track number.

    Validation first (it gives the address), then the confidence gate and the duplicate filter on raw frames,
    then the decoding of what is left. Each source has a gate of its own; multilaterated frames pass it and
    make their address trusted for radio frames. Duplicates are those one radio receiver hears
    again; other sources keep theirs unless ``across_receivers`` filters over everything. Gate, filter and
    tracks share one shuffle by address; sorts carry the frames alone, messages are decoded after them.
    ``rows_per_slice`` set: addresses of more rows are cut into slices for everything downstream; ``rows`` is the
    number of frames, or a bound of it, if it is known without counting; ``sample`` draws a share of the frames where that costs less
    than making them all. Only the places of the cuts come from it. ``settle`` writes the frames of the tracks to the shared
    folder, for results that read the messages more than once. ``fields`` are those to decode (``decode_messages``), all by default.
    """
    valid = validate_frames(frames)
    if rows_per_slice is not None:
        valid = split_hot_keys(valid, [[KEY]], ORDER, rows_per_slice, rows=frames.count() if rows is None else rows,
                               sample=lambda share: validate_frames(sample(share) if sample else frames.sample(share, seed=7)))
    valid = valid.repartition(*partition_columns(valid, KEY))
    valid = valid.withColumns({"_radio": F.expr("source = 'Sdr'"), "_group": F.expr("CASE WHEN source = 'Mlat' THEN 'Sdr' ELSE source END")})
    if confidence is not None:
        n = CONFIDENCE_LEVELS[confidence] if isinstance(confidence, str) else confidence
        valid = confidence_gate(valid, [KEY, "_group"], "ts", n, gate_timeout, ORDER, F.expr("source = 'Mlat'"))
    if across_receivers:
        unique = dedup_within(valid, [KEY, "frame"], "ts", window, ORDER)
    else:
        unique = dedup_within(valid, [KEY, "receiver", "frame", "_radio"], "ts", window, ORDER, only=F.col("_radio"))
    decodable = classify(unique.drop("_radio", "_group")).where("msg_type IS NOT NULL").drop("tc", "msg_type")
    tracks = sessionize(decodable, KEY, "ts", track_timeout, ORDER)
    # With slices every later scan starts a job on the hot rows; they begin from a written table, too.
    return decode_messages(cut_lineage(tracks) if settle or slice_of(tracks, KEY) else tracks, fields=fields)


def track_positions(messages: DataFrame, receiver=None, max_age="10 seconds", timeout="60 seconds") -> DataFrame:
    """One row per position report: its own position and the track's position after it.

    Only the dozen columns the position needs go through the fold.
    """
    slices = [c for c in messages.columns if c.startswith("_slice__")]
    rows = messages.selectExpr(
        "icao_raw", "session", "ts", "frame_id", "msg_type", "source", *[f"`{c}`" for c in slices],
        "CASE WHEN msg_type = 'airborne_position' THEN airborne_position.cpr_odd END AS air_odd",
        "airborne_position.cpr_lat AS cpr_lat", "airborne_position.cpr_lon AS cpr_lon",
        "surface_position.cpr_odd AS surface_odd", "surface_position.cpr_lat AS surface_lat",
        "surface_position.cpr_lon AS surface_lon", "velocity.speed_kt AS speed",
    ).where(f"{AIRBORNE} OR {SURFACE} OR {VELOCITY}")
    rows = state_as_of(rows, KEY, ORDER, [overwrite("air_speed", "speed", VELOCITY)], "session").where(f"NOT {VELOCITY}")
    rows = pair_latest(rows, KEY, "air_odd", "ts", ["cpr_lat", "cpr_lon"], max_age, ORDER)
    rows = rows.withColumn("paired", F.col("paired") & F.expr(AIRBORNE))
    lat, lon = receiver if receiver else (None, None)
    rows = range_guard(decode_airborne_cpr(rows), lat, lon).withColumnsRenamed({"lat": "air_lat", "lon": "air_lon"})
    rows = decode_surface_cpr(rows, lat, lon, "surface_lat", "surface_lon", "surface_odd")
    on_ground = F.expr(SURFACE)
    rows = rows.select(
        "icao_raw", "session", "ts", "frame_id", "source", *slices, on_ground.alias("on_ground"), "air_speed",
        F.when(on_ground, F.col("lat")).otherwise(F.col("air_lat")).alias("lat"),
        F.when(on_ground, F.col("lon")).otherwise(F.col("air_lon")).alias("lon"))
    return plausible_track(rows, KEY, "ts", ORDER, speed="air_speed", surface="on_ground", session="session", timeout=timeout)


#: Reports of altitude as columns: barometric and geometric positions, their difference, and replies.
ALTITUDE_REPORTS = {
    "_baro": "CASE WHEN airborne_position.altitude_type = 'Barometric' THEN airborne_position.altitude_ft END",
    "_geo": "CASE WHEN airborne_position.altitude_type = 'Geometric' THEN airborne_position.altitude_ft END",
    "_delta": "velocity.geo_delta",
    "_reply": "coalesce(altitude_reply.altitude_ft, air_air_short.altitude_ft, air_air_long.altitude_ft)",
}


def with_altitudes(messages: DataFrame) -> DataFrame:
    """Add ``baro_ft``, ``geo_ft`` and ``delta_ft`` as known after every message."""
    reports = messages.withColumns({name: F.expr(sql) for name, sql in ALTITUDE_REPORTS.items()})
    return derive_altitude(reports, KEY, ORDER, *ALTITUDE_REPORTS, "session").drop(*ALTITUDE_REPORTS)


ALTITUDE_RULES = [keep_known("baro_ft"), keep_known("geo_ft"), keep_known("delta_ft")]


#: What ``track_weather`` knows, with the columns that it replaces or adds.
COMPUTED = {"wind_speed_kt": ("wind_speed", "int"), "wind_direction": ("wind_direction", "double"), "static_temperature": ("static_temperature", "double"),
            "total_temperature": ("total_temperature", "double"), "true_heading": ("true_heading", "double"),
            "magnetic_declination": ("magnetic_declination", "double")}
ADDED = {"meteorology": ["total_temperature"], "dynamics": ["true_heading", "magnetic_declination"]}


def aircraft_state(messages: DataFrame, positions: DataFrame | None = None, rules=None, weather: DataFrame | None = None) -> DataFrame:
    """One row per track with a struct per section, all fields merged by their rules.

    One aggregation, combined before the shuffle, without a sort of whole messages: altitudes, which need running columns, are
    worked out on the columns they need. They, positions and ``weather`` (of ``track_weather``: computed and
    reported values, the latest wins) are joined as one row per track, so the joins see no hot key.
    """
    rules = rules or SECTION_RULES
    flat = [r for members in rules.values() for r in members]
    state = latest_state(
        messages, TRACK, ORDER,
        [*flat, overwrite("signal", "signal"), overwrite("icao", "icao")],
        [*counter_aggregates("ts", "msg_type"), mlat_aggregate("source", "msg_type")])
    slices = [f"`{c}`" for c in messages.columns if c.startswith("_slice__")]
    heights = messages.selectExpr(*TRACK, *ORDER, *slices, *[f"{sql} AS `{name}`" for name, sql in ALTITUDE_REPORTS.items()])
    heights = heights.where(" OR ".join(f"{name} IS NOT NULL" for name in ALTITUDE_REPORTS))
    heights = latest_state(derive_altitude(heights, KEY, ORDER, *ALTITUDE_REPORTS, "session"), TRACK, ORDER, ALTITUDE_RULES)
    state = state.join(heights, TRACK, "left")
    if positions is not None:
        last = latest_state(positions, TRACK, ORDER, [
            overwrite("lat", "track_lat"), overwrite("lon", "track_lon"),
            overwrite("position_ts", "cast(timestamp_micros(position_us) as timestamp_ntz)")])
        state = state.join(last, TRACK, "left")
    else:
        state = state.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"),
                                   "position_ts": F.lit(None).cast("timestamp_ntz")})
    if weather is not None:
        last = latest_state(weather, TRACK, ORDER, [*[overwrite(name, column) for name, (column, _) in COMPUTED.items()],
                                                    overwrite("weather_ts", "ts", "weather_changed")])
        state = state.drop(*COMPUTED, "weather_ts").join(last, TRACK, "left")
    return in_sections(state, rules)


def in_sections(state: DataFrame, rules) -> DataFrame:
    """A flat state as one struct per section; what was not computed is null."""
    state = state.withColumns({n: F.lit(None).cast(kind) for n, (_, kind) in COMPUTED.items() if n not in state.columns})
    structs = {name: [*[r.name for r in members], *ADDED.get(name, [])] for name, members in rules.items()}
    structs["identification"] = ["icao", *structs.get("identification", [])]
    structs["position"] = ["lat", "lon", "position_ts", "baro_ft", "geo_ft", "delta_ft", "had_mlat", *structs.get("position", [])]
    structs["status"] = ["signal", "total_messages", "position_messages", "velocity_messages", "identification_messages",
                         "first_seen", "last_seen", "seen_seconds", "seen_pos_seconds"]
    return state.select(*TRACK, "icao", *[F.struct(*fields).alias(name) for name, fields in structs.items()])


def current_tracks(state: DataFrame, at: Column | None = None, timeout_us: int = 60_000_000) -> DataFrame:
    """The newest track of every aircraft; with ``at`` only those not yet expired then."""
    fields = [c for c in state.columns if c != KEY]
    newest = state.groupBy(KEY).agg(F.max_by(F.struct(*fields), "session").alias("_t"))
    out = newest.select(KEY, *[F.col(f"_t.{c}").alias(c) for c in fields])
    return out if at is None else out.where(micros(at) - micros("status.last_seen") <= timeout_us)


HISTORY_RULES = [
    *[r for r in SECTION_RULES["velocity"] if r.name in (
        "speed_kt", "speed_type", "vertical_rate", "velocity_subtype", "track", "heading", "ground_speed_kt", "ground_track")],
    *[r for r in SECTION_RULES["position"] if r.name == "nac_p"],
]


#: What the histories and the positions read of a message. Messages of other kinds change neither.
HISTORY_FIELDS = {
    "airborne_position": ["cpr_odd", "cpr_lat", "cpr_lon", "altitude_ft", "altitude_type"],
    "surface_position": ["cpr_odd", "cpr_lat", "cpr_lon", "ground_speed_kt", "ground_track"],
    "velocity": ["subtype", "speed_kt", "speed_type", "track", "heading", "vertical_rate", "geo_delta"],
    "operational_status": ["nac_p"],
    "altitude_reply": ["altitude_ft"],
    "air_air_short": ["altitude_ft"],
    "air_air_long": ["altitude_ft"],
}


def tracked_rows(messages: DataFrame, positions: DataFrame) -> DataFrame:
    """The history columns as known after every message, for the four history kinds.

    Positions (of the same messages) go in as rows right before their messages, so that one shuffle by address serves all: a
    join by frame would take two, of all messages, or a broadcast that grows with them.
    """
    slices = [f"`{c}`" for c in messages.columns if c.startswith("_slice__")]
    rows = messages.selectExpr(*TRACK, "icao", *ORDER, "msg_type", "source", *slices, *HISTORY_FIELDS, "true AS _message")
    fixes = positions.where("frame_id IS NOT NULL").selectExpr(*TRACK, *ORDER, *slices, "struct(track_lat, track_lon) AS fix", "false AS _message")
    rows = rows.unionByName(fixes, allowMissingColumns=True)
    if slices:  # every scan from here on starts a job on the hot rows
        rows = cut_lineage(rows)
        rows = rows.select(*[F.col(c).alias(c, metadata=messages.schema[c].metadata) if c.startswith("_slice__") else c for c in rows.columns])
    rows = state_as_of(rows, KEY, [*ORDER, "_message"], [overwrite("_fix", "fix", "fix IS NOT NULL")], "session").where("_message")
    out = state_as_of(with_altitudes(rows), KEY, ORDER, HISTORY_RULES, "session")
    return out.withColumns({"lat": F.col("_fix.track_lat"), "lon": F.col("_fix.track_lon")}).select(
        *TRACK, "icao", *ORDER, *[c.strip("`") for c in slices], "lat", "lon", "baro_ft", "geo_ft", *[r.name for r in HISTORY_RULES])


__all__ = ["SECTION_RULES", "aircraft_state", "current_tracks", "received_messages", "track_positions",
           "tracked_rows", "with_altitudes"]
