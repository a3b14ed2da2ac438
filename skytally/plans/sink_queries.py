"""Exports run on the derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skytally import streaming
from skytally.operators import aircraft, history, tracks
from skytally.operators.stages import shared_folder
from skytally.plans.catalog import events, query, table
from skytally.plans.derive import FLAT_COLUMNS
from skytally.plans.event_queries import _SESSION
from skytally.plans.frame_queries import (
    _BARO,
    _C20,
    _CALL,
    _GEOM,
    _IS_V,
    _O,
    _RECEIVED,
    _REPLY,
    _STAT,
    _SURF,
    _TRACKED,
    _VEL,
    FRAMES,
    _as_of,
    b,
    chars,
    messages,
    positions,
    raw,
    sqk,
)
from skytally.plans.frame_queries import _HISTORIES
from skytally.sinks import basestation_rows, to_basestation, to_ndjson, to_wire, write_history
from skytally.plans.stream_queries import finished, replay
from skytally.sources import read_capture_stream, read_captures, read_frames, read_registry, write_captures

USER_ORDER = ["ts", "event_id"]


def _lines_sql(flat: str, key: str, number_column: str) -> str:
    """Check SQL of the lines of a table expression ``flat`` with the columns ``to_basestation`` takes."""
    stamp = "strftime(ts, '%Y/%m/%d,%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0')"
    t1, t6 = "coalesce(printf('%.1f', round(track, 1)), '')", "coalesce(printf('%.6f', {0}), '')"
    alt, spd, vr = (f"coalesce(CAST({x} AS VARCHAR), '')" for x in ("altitude_ft", "speed_kt", "vertical_rate"))
    lat, lon = t6.format("lat"), t6.format("lon")
    gnd = "CASE WHEN on_ground THEN '-1' ELSE '0' END"
    alert = "CASE WHEN flight_status IN (2, 3, 4) THEN '-1' WHEN flight_status IN (0, 1, 5) THEN '0' ELSE '' END"
    spi = "CASE WHEN flight_status IN (4, 5) THEN '-1' WHEN flight_status < 4 THEN '0' ELSE '' END"
    emg = "CASE coalesce(emergency, 0) WHEN 0 THEN '0' WHEN 7 THEN '' ELSE '-1' END"
    head = f"icao || ',1,' || {stamp} || ',' || {stamp} || ','"
    tails = f"""CASE msg_type WHEN 'identification' THEN coalesce(callsign, '') || ',,,,,,,,,,'
        WHEN 'surface_position' THEN ',,' || {spd} || ',' || {t1} || ',' || {lat} || ',' || {lon} || ',,,,,,-1'
        WHEN 'airborne_position' THEN ',' || {alt} || ',,,' || {lat} || ',' || {lon} || ',,' || {alert} || ',' || {emg} || ',' || {spi} || ',' || {gnd}
        WHEN 'velocity' THEN ',,' || {spd} || ',' || {t1} || ',,,' || {vr} || ',,,,,'
        WHEN 'altitude_reply' THEN ',' || {alt} || ',,,,,,' || {alert} || ',,' || {spi} || ',' || {gnd}
        WHEN 'identity_reply' THEN ',' || {alt} || ',,,,,,' || coalesce(squawk, '') || ',' || {alert} || ',' || {emg} || ',' || {spi} || ',' || {gnd}
        WHEN 'all_call' THEN ',,,,,,,,,,,' || {gnd} ELSE ',' || {alt} || ',,,,,,,,,,' || {gnd} END"""
    number = ("CASE msg_type WHEN 'identification' THEN 1 WHEN 'surface_position' THEN 2 WHEN 'airborne_position' THEN 3 WHEN 'velocity' THEN 4 "
              "WHEN 'altitude_reply' THEN 5 WHEN 'identity_reply' THEN 6 WHEN 'all_call' THEN 8 ELSE 7 END")
    w = f"PARTITION BY {key}, session ORDER BY ts, {number_column}"
    known = ("identification", "surface_position", "airborne_position", "velocity", "altitude_reply", "identity_reply", "all_call", "air_air_short", "air_air_long")
    kinds = ", ".join(f"'{k}'" for k in known)
    return f"""{flat},
        o AS (SELECT *, row_number() OVER ({w}) AS rn, count(*) FILTER (msg_type = 'identification' AND callsign IS NOT NULL) OVER ({w}) AS named,
          count(*) FILTER (msg_type IN ('identification', 'surface_position', 'airborne_position', 'velocity', 'all_call')) OVER ({w}) AS es FROM flat)
        SELECT icao, {number_column}, 0 AS part, 'AIR,,1,1,' || {head} || ',,,,,,,,,,,' AS line FROM o WHERE rn = 1
        UNION ALL SELECT icao, {number_column}, 1, 'MSG,' || {number} || ',1,1,' || {head} || {tails} FROM o
          WHERE (msg_type NOT IN ('altitude_reply', 'identity_reply') OR es > 0) AND msg_type IN ({kinds})
        UNION ALL SELECT icao, {number_column}, 2, 'ID,,1,1,' || {head} || callsign || ',,,,,,,,,,' FROM o
          WHERE msg_type = 'identification' AND callsign IS NOT NULL AND named = 1"""


_FLAT_LINES = _lines_sql(f"""WITH {_SESSION}, flat AS (SELECT event_id, ts, user_id, session, {', '.join(FLAT_COLUMNS)},
    '4' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS icao FROM ses)""", "user_id", "event_id")
_ON_GROUND = "msg_type = 'surface_position'"
_AIRCRAFT_LINES = _lines_sql(f"""WITH RECURSIVE {_TRACKED}, flat AS (SELECT m.frame_id, m.ts, m.icao_raw, m.session, m.msg_type, upper(lpad(to_hex(m.icao_raw), 6, '0')) AS icao,
    {_as_of(f"CASE WHEN msg_type = 'identification' THEN rtrim({chars(41)}) ELSE {_C20} END", _CALL)} AS callsign,
    coalesce({_BARO}, {_GEOM}, {_REPLY}, {_as_of(f"coalesce({_BARO}, {_REPLY})")}) AS altitude_ft,
    CASE WHEN {_ON_GROUND} THEN {_as_of(f"CASE WHEN {_ON_GROUND} THEN {_SURF['ground_speed_kt']} END")} ELSE {_as_of(_VEL['speed_kt'], _IS_V)} END AS speed_kt,
    CASE WHEN {_ON_GROUND} THEN {_as_of(f"CASE WHEN {_ON_GROUND} THEN {_SURF['ground_track']} END")}
      ELSE coalesce(CASE WHEN {_IS_V} THEN coalesce({_VEL['track']}, {_VEL['heading']}) END, {_as_of(_VEL['track'], f"{_IS_V} AND {b(38, 3)} IN (1, 2)")}) END AS track,
    t.lat, t.lon, coalesce(CASE WHEN {_IS_V} THEN {_VEL['vertical_rate']} END, {_as_of(_VEL['vertical_rate'], _IS_V)}) AS vertical_rate,
    CASE WHEN msg_type = 'identity_reply' THEN {sqk(b(20, 13))} END AS squawk,
    {_as_of(f"CASE WHEN msg_type = 'air_air_short' THEN {b(6, 1)} ELSE {b(6, 3)} END", "msg_type IN ('altitude_reply', 'identity_reply', 'air_air_short')")} AS flight_status,
    {_as_of(f"CASE WHEN msg_type = 'status' THEN {_STAT['emergency']} END")} AS emergency,
    {_as_of(_ON_GROUND, "msg_type IN ('airborne_position', 'surface_position')")} AS on_ground
    FROM msg m LEFT JOIN (SELECT frame_id, lat, lon FROM tp) t USING (frame_id))""", "icao_raw", "frame_id")


@query("text_lines", _FLAT_LINES)
def text_lines_query(spark, folder):
    rows = tracks.sessionize(events(spark, folder, ["user_id"]), "user_id", "ts", "6 hours", USER_ORDER)
    slices = [f"`{c}`" for c in rows.columns if c.startswith("_slice__")]
    flat = rows.selectExpr("event_id", "ts", "user_id", "session", *slices, *FLAT_COLUMNS,
                           "concat('4', lpad(cast(user_id as string), 5, '0')) AS icao")
    return to_basestation(flat, "user_id", "ts", USER_ORDER).select("icao", "event_id", "part", "line")


@query("stream_text_lines", _FLAT_LINES)
def stream_lines_query(spark, folder):
    """The same lines from a stream, tracks told apart by the keyed step."""
    def lines(df):
        flat = df.selectExpr("event_id", "ts", "user_id", *FLAT_COLUMNS, "concat('4', lpad(cast(user_id as string), 5, '0')) AS icao")
        return streaming.text_line_stream(flat, "user_id", "ts", "6 hours", USER_ORDER)

    return replay(spark, folder, lines).select("icao", "event_id", "part", "line")


@query("aircraft_text_lines", _AIRCRAFT_LINES)
def aircraft_lines_query(spark, folder):
    rows = messages(spark, folder)
    return to_basestation(basestation_rows(rows, positions(rows)), "icao_raw", "ts", ["ts", "frame_id"]).select("icao", "frame_id", "part", "line")


@query("wire_records", f"""WITH {FRAMES}, h AS (SELECT frame_id, frame, upper(lpad(to_hex(ts12 & 281474976710655), 12, '0'))
      || upper(lpad(to_hex(CAST(round_even(255 * sqrt(signal / 255), 0) AS BIGINT)), 2, '0')) || frame AS body FROM frames),
    p AS (SELECT frame_id, frame, list_transform(range(0, CAST(length(body) // 2 AS BIGINT)), lambda i: substr(body, i * 2 + 1, 2)) AS bytes FROM h)
    SELECT frame_id, '1A' || CASE WHEN length(frame) = 28 THEN '33' ELSE '32' END
      || list_reduce(list_transform(bytes, lambda x: CASE WHEN x = '1A' THEN '1A1A' ELSE x END), lambda x, y: x || y) AS wire FROM p""")
def wire_query(spark, folder):
    return to_wire(raw(spark, folder)).select("frame_id", F.hex("wire").alias("wire"))


@query("json_lines", f"""WITH {_RECEIVED}, st AS (SELECT icao_raw, session,
      (arg_max({{'v': CASE WHEN msg_type = 'identification' THEN rtrim({chars(41)}) ELSE trim({chars(41)}) END}}, {_O}) FILTER ({_CALL})).v AS callsign,
      (arg_max({{'v': {_VEL['speed_kt']}}}, {_O}) FILTER (msg_type = 'velocity')).v AS knots,
      arg_max({_SURF['ground_speed_kt']}, {_O}) FILTER (msg_type = 'surface_position' AND {_SURF['ground_speed_kt']} IS NOT NULL) AS ground_knots,
      arg_max({b(6, 3)}, {_O}) FILTER (msg_type = 'all_call') AS level, count(*) AS total, max(ts) AS last_seen FROM msg GROUP BY icao_raw, session),
    cur AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY icao_raw ORDER BY session DESC) = 1)
    SELECT upper(lpad(to_hex(icao_raw), 6, '0')) AS icao, callsign, CAST(knots AS VARCHAR) AS knots,
      CAST(CAST(round_even(ground_knots * 1.852::DOUBLE, 0) AS INT) AS VARCHAR) AS ground_kmh,
      CASE level WHEN 0 THEN 'Level 1' WHEN 4 THEN 'Level 2+ (On Ground)' WHEN 5 THEN 'Level 2+ (Airborne)' WHEN 6 THEN 'Level 2+ (On Ground or Airborne)'
        WHEN 7 THEN 'DR ≠ 0 or Special Flight Status' ELSE CASE WHEN level IS NOT NULL THEN 'Reserved' END END AS transponder,
      CAST(total AS VARCHAR) AS total FROM cur""")
def json_query(spark, folder):
    state = aircraft.current_tracks(aircraft.aircraft_state(messages(spark, folder)))
    paths = {"callsign": "Identification.Callsign", "knots": "VelocityAndDynamics.Speed.Knots",
             "ground_kmh": "VelocityAndDynamics.SpeedOnGround.KilometersPerHour", "transponder": "Capabilities.TransponderLevel",
             "total": "Status.TotalMessages"}
    return to_ndjson(state).select("icao", *[F.get_json_object("json", f"$.{p}").alias(n) for n, p in paths.items()])


# --- files written and read again ----------------------------------------------------------


def _new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("frame_files", f"WITH {FRAMES} SELECT frame_id, frame, ts12, source, receiver FROM frames")
def frame_files_query(spark, folder):
    """Frames through JSON files."""
    path = _new_folder(spark, "frames")
    raw(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")).write.json(path)
    return read_frames(spark, path, "json").select("frame_id", "frame", "ts12", "source", "receiver")


@query("registry_files", """SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS icao, c_name AS registration, c_mktsegment AS operator_name,
    c_custkey % 5 = 0 AS military, CAST(NULL AS BOOLEAN) AS pia FROM customer""")
def registry_files_query(spark, folder):
    """The registry through CSV files with the published column names, one flag missing."""
    path = _new_folder(spark, "registry")
    table(spark, folder, "customer").selectExpr(
        "lpad(cast(c_custkey as string), 6, '0') AS icao", "c_name AS aircraft_registration", "c_mktsegment AS operator_name",
        "cast(c_custkey % 5 = 0 as int) AS military").write.option("header", True).csv(path)
    return read_registry(spark, path, "csv").select("icao", "registration", "operator_name", "military", "pia")


@query("history_files", f"SELECT icao_raw, session, seq, altitude_ft, altitude_type FROM ({_HISTORIES['altitude']})")
def history_files_query(spark, folder):
    """The altitude history through files by date and kind."""
    rows = messages(spark, folder)
    path = _new_folder(spark, "history")
    write_history(history.altitude_history(aircraft.tracked_rows(rows, positions(rows)), aircraft.TRACK, ["ts", "frame_id"]), path)
    return spark.read.parquet(path).where("kind = 'altitude'").select("icao_raw", "session", "seq", "altitude_ft", "altitude_type")


_CAPTURED = f"""WITH {FRAMES} SELECT receiver, frame, ts12 & 281474976710655 AS ts12, CAST(round_even(255 * sqrt(signal / 255), 0) AS INT) AS level FROM frames"""


def _captures(spark, folder) -> str:
    path = _new_folder(spark, "captures")
    write_captures(to_wire(raw(spark, folder)), path, order=["ts", "frame_id"])
    return path


def _captured(rows):
    level = F.rint(255 * F.sqrt(F.col("signal") / 255)).cast("int").alias("level")
    return rows.select(F.split("receiver", "-part-")[0].alias("receiver"), "frame", "ts12", level)


@query("capture_files", _CAPTURED)
def capture_files_query(spark, folder):
    """Frames through capture files, read by ranges of bytes that cut records anywhere."""
    return _captured(read_captures(spark, _captures(spark, folder), "2024-01-01 00:00:00", range_bytes=100_001))


@query("stream_captures", _CAPTURED)
def stream_captures_query(spark, folder):
    """The same files as a stream."""
    stream = read_capture_stream(spark, _captures(spark, folder), "2024-01-01 00:00:00", range_bytes=100_001)
    return _captured(finished(stream))
