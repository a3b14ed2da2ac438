"""Comma-separated text lines, one kind per message family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.operators.ordered import Latest, Previous, as_list, drop_slices, scan
from skytally.operators.tracks import keep_known, overwrite, state_as_of

# Transmission type per message kind, and the part of the line after the times.
TRANSMISSION = {
    "identification": 1, "surface_position": 2, "airborne_position": 3, "velocity": 4, "altitude_reply": 5,
    "identity_reply": 6, "air_air_short": 7, "air_air_long": 7, "all_call": 8,
}
TAILS = {
    1: "{callsign},,,,,,,,,,",
    2: ",,{speed},{track},{lat},{lon},,,,,,-1",
    3: ",{altitude},,,{lat},{lon},,{alert},{emergency},{spi},{ground}",
    4: ",,{speed},{track},,,{climb},,,,,",
    5: ",{altitude},,,,,,{alert},,{spi},{ground}",
    6: ",{altitude},,,,,,{squawk},{alert},{emergency},{spi},{ground}",
    7: ",{altitude},,,,,,,,,,{ground}",
    8: ",,,,,,,,,,,{ground}",
}
NEEDS_SQUITTER = (5, 6)
SQUITTER_KINDS = ("identification", "surface_position", "airborne_position", "velocity", "all_call")


def basestation_flags(df: DataFrame) -> DataFrame:
    """Add ``alert``, ``emergency_flag``, ``spi`` and ``ground`` as ``-1``, ``0`` or empty text."""
    return df.selectExpr(
        "*",
        "CASE WHEN flight_status IN (2, 3, 4) THEN '-1' WHEN flight_status IN (0, 1, 5) THEN '0' ELSE '' END AS alert",
        "CASE WHEN coalesce(emergency, 0) BETWEEN 1 AND 6 THEN '-1' WHEN coalesce(emergency, 0) = 0 THEN '0' ELSE '' END AS emergency_flag",
        "CASE WHEN flight_status IN (4, 5) THEN '-1' WHEN flight_status BETWEEN 0 AND 3 THEN '0' ELSE '' END AS spi",
        "CASE WHEN coalesce(on_ground, false) THEN '-1' ELSE '0' END AS ground",
    )


def basestation_gate(df: DataFrame, key, order, session: str = "session", kind: str = "msg_type") -> DataFrame:
    """Add ``is_first`` (first row of a track), ``announces`` (first known callsign) and ``may_send``.

    Surveillance replies are sent only after the aircraft sent a squitter in the same track.
    """
    kinds = ", ".join(f"'{k}'" for k in SQUITTER_KINDS)
    rows = state_as_of(df, key, order, [keep_known("_squitter", "true", f"{kind} IN ({kinds})")], session)
    named = F.expr(f"{kind} = 'identification' AND callsign IS NOT NULL")
    rows = scan(rows, key, order, _last=Previous(F.col(session)), _named=Latest(F.col(session), named))
    rows = scan(rows, key, order, _before=Previous(F.col("_named")))
    return rows.withColumns({
        "is_first": ~F.col("_last").eqNullSafe(F.col(session)),
        "announces": named & ~F.col("_before").eqNullSafe(F.col(session)),
        "may_send": F.expr(f"{kind} NOT IN ('altitude_reply', 'identity_reply') OR coalesce(_squitter, false)"),
    }).drop("_squitter", "_last", "_named", "_before")


def formatted_lines(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``air_line``, ``msg_line`` and ``id_line``, whether they are to be sent or not; native, row by row."""
    rows = basestation_flags(df)
    number = "CASE msg_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in TRANSMISSION.items()) + " END"
    stamp = f"concat(date_format({ts}, 'yyyy/MM/dd'), ',', date_format({ts}, 'HH:mm:ss.SSS'))"
    fields = {
        "callsign": "coalesce(callsign, '')", "altitude": "coalesce(cast(altitude_ft as string), '')",
        "speed": "coalesce(cast(speed_kt as string), '')", "track": "CASE WHEN track IS NULL THEN '' ELSE format_string('%.1f', track) END",
        "lat": "CASE WHEN lat IS NULL THEN '' ELSE format_string('%.6f', lat) END", "lon": "CASE WHEN lon IS NULL THEN '' ELSE format_string('%.6f', lon) END",
        "climb": "coalesce(cast(vertical_rate as string), '')", "squawk": "coalesce(squawk, '')",
        "alert": "alert", "emergency": "emergency_flag", "spi": "spi", "ground": "ground",
    }

    def tail(template):
        parts = []
        for i, piece in enumerate(template.replace("{", "\0").replace("}", "\0").split("\0")):
            parts.append(fields[piece] if i % 2 else f"'{piece}'")
        return "concat(" + ", ".join(parts) + ")"

    tails = "CASE _type " + " ".join(f"WHEN {n} THEN {tail(t)}" for n, t in TAILS.items()) + " END"
    rows = rows.selectExpr("*", f"{number} AS _type", f"concat({stamp}, ',', {stamp}) AS _times")
    return rows.selectExpr(
        "*", "concat('AIR,,1,1,', icao, ',1,', _times, ',,,,,,,,,,,,') AS air_line",
        f"CASE WHEN _type IS NOT NULL THEN concat('MSG,', _type, ',1,1,', icao, ',1,', _times, ',', {tails}) END AS msg_line",
        "concat('ID,,1,1,', icao, ',1,', _times, ',', callsign, ',,,,,,,,,,') AS id_line")


def sent_lines(df: DataFrame, order) -> DataFrame:
    """The lines that the gate's columns let through, with their place in the output."""
    lines = ", ".join([
        "struct(0 AS part, CASE WHEN is_first THEN air_line END AS line)", "struct(1 AS part, CASE WHEN may_send THEN msg_line END AS line)",
        "struct(2 AS part, CASE WHEN announces THEN id_line END AS line)",
    ])
    kept = [f"`{c}`" for c in dict.fromkeys(["icao", *as_list(order)])]
    return drop_slices(df).selectExpr(*kept, f"inline(array({lines}))").where("line IS NOT NULL")


def to_basestation(df: DataFrame, key="icao", ts: str = "ts", order=None, session: str = "session") -> DataFrame:
    """Lines of a flat message table, with their place in the output.

    Columns: ``msg_type``, ``callsign, altitude_ft, speed_kt, track, lat, lon, vertical_rate,
    squawk, flight_status, emergency, on_ground``, each the message's value or else the
    state's. A track opens with an ``AIR`` line; the first known callsign adds an ``ID`` line.
    """
    order = order or [ts]
    return sent_lines(formatted_lines(basestation_gate(df, key, order, session), ts), order)


def basestation_rows(messages: DataFrame, positions: DataFrame, key="icao_raw", order=("ts", "frame_id")) -> DataFrame:
    """The flat table ``to_basestation`` takes, from decoded messages and their positions."""
    reported = positions.select(key, "frame_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    rows = messages.join(reported, [key, "frame_id"], "left")
    rules = [
        overwrite("callsign", "coalesce(identification.callsign, bds_20.callsign)",
                  "msg_type = 'identification' OR (bds = '2,0' AND bds_20.callsign <> '')"),
        keep_known("_baro", "CASE WHEN airborne_position.altitude_type = 'Geometric' THEN NULL ELSE coalesce(airborne_position.altitude_ft, "
                            "altitude_reply.altitude_ft, air_air_short.altitude_ft, air_air_long.altitude_ft) END"),
        overwrite("_speed", "velocity.speed_kt", "msg_type = 'velocity'"),
        overwrite("_track", "velocity.track", "msg_type = 'velocity' AND velocity.subtype IN (1, 2)"),
        overwrite("_climb", "velocity.vertical_rate", "msg_type = 'velocity'"),
        keep_known("_surface_speed", "surface_position.ground_speed_kt"),
        keep_known("_surface_track", "surface_position.ground_track"),
        overwrite("_status", "coalesce(altitude_reply.flight_status, identity_reply.flight_status, cast(air_air_short.on_ground as int))",
                  "msg_type IN ('altitude_reply', 'identity_reply', 'air_air_short')"),
        keep_known("emergency", "status.emergency"),
        overwrite("on_ground", "msg_type = 'surface_position'", "msg_type IN ('airborne_position', 'surface_position')"),
    ]
    state = state_as_of(rows, key, list(order), rules, "session")
    surface = "msg_type = 'surface_position'"
    slices = [f"`{c}`" for c in state.columns if c.startswith("_slice__")]
    return state.selectExpr(
        key, "icao", "session", *order, *slices, "msg_type", "callsign",
        "coalesce(airborne_position.altitude_ft, altitude_reply.altitude_ft, air_air_short.altitude_ft, air_air_long.altitude_ft, _baro) AS altitude_ft",
        f"CASE WHEN {surface} THEN _surface_speed ELSE _speed END AS speed_kt",
        f"CASE WHEN {surface} THEN _surface_track ELSE coalesce(velocity.track, velocity.heading, _track) END AS track",
        "_lat AS lat", "_lon AS lon", "coalesce(velocity.vertical_rate, _climb) AS vertical_rate",
        "identity_reply.squawk AS squawk", "_status AS flight_status", "emergency", "on_ground")
