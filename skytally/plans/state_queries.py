"""The whole state of every track, from a batch and from a stream, against one check SQL for all sections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skytally import streaming
from skytally.operators import aircraft
from skytally.operators.stages import shared_folder
from skytally.plans.catalog import ORACLES, query
from skytally.plans.derive import RECEIVER
from skytally.plans.frame_queries import (
    _B50, _C20, _CALL, _DF0, _DF16, _FIELDS, _IDENT, _O, _OPS, _STAT, _STATES, _SURF, _TGT, _VEL, b, chars, heard, messages, positions, rounded, sqk,
)
from skytally.plans.stream_queries import settings

CHAIN = {"n": 5, "track_timeout": "120 seconds", "pair_age": "60 seconds", "receiver": RECEIVER}


def of(*kinds: str) -> str:
    return "msg_type IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"


def reg(*codes: str) -> str:
    return "coalesce(bds IN (" + ", ".join(f"'{k}'" for k in codes) + "), false)"


def newest(value: str, when: str) -> str:
    """Value of the newest row with ``when``, null included."""
    return f"(arg_max({{'v': {value}}}, {_O}) FILTER ({when})).v"


def known(value: str, when: str) -> str:
    """Newest known value of rows with ``when``."""
    return f"arg_max({value}, {_O}) FILTER ({when} AND ({value}) IS NOT NULL)"


def either(field: str, *codes: str, names: tuple = ()) -> str:
    """A field that several registers have, known values only."""
    values = " ".join(f"WHEN bds = '{k}' THEN {_FIELDS[k][n]}" for k, n in zip(codes, names or [field] * len(codes), strict=True))
    return known(f"CASE {values} END", reg(*codes))


_VELOCITY, _SURFACE, _AIRBORNE, _BOTH = of("velocity"), of("surface_position"), of("airborne_position"), of("airborne_position", "surface_position")
_OP, _TARGET, _SHORT, _LONG, _DYN = of("operational_status"), of("target_state"), of("air_air_short"), of("air_air_long"), reg("5,0", "5,3", "6,0")
_CLASS, _MODE, _F40 = f"{_OP} AND {_OPS['has_capability']}", f"{_OP} AND {_OPS['has_mode']}", _FIELDS["4,0"]
_AP = f"{_TARGET} OR {reg('4,0')}"


def selected(target: str, register: str) -> str:
    return f"arg_max(CASE WHEN {_TARGET} THEN {target} ELSE {register} END, {_O}) FILTER (({_AP}) AND (CASE WHEN {_TARGET} THEN {target} ELSE {register} END) IS NOT NULL)"


def turned_on(target: str, bit: int) -> str:
    return selected(target, f"CASE WHEN {_F40['nav_modes']} & {bit} <> 0 THEN true END")


FIELDS = {
    "callsign": newest(f"CASE WHEN msg_type = 'identification' THEN rtrim({chars(41)}) ELSE {_C20} END", _CALL),
    "category": newest(_IDENT["category"], of("identification")),
    "squawk": newest(f"CASE WHEN msg_type = 'identity_reply' THEN {sqk(b(20, 13))} ELSE {sqk(b(44, 13))} END",
                     f"msg_type = 'identity_reply' OR (msg_type = 'status' AND {b(38, 3)} = 1 AND {b(44, 13)} <> 0)"),
    "emergency": known(_STAT["emergency"], of("status")),
    "flight_status": newest(f"CASE WHEN msg_type = 'air_air_short' THEN {b(6, 1)} ELSE {b(6, 3)} END", of("altitude_reply", "identity_reply", "air_air_short")),
    "version": newest(_OPS["version"], _OP),
    "antenna": newest(b(40, 1), _AIRBORNE), "on_ground": newest(_SURFACE, _BOTH), "movement": newest(_SURF["movement"], _SURFACE),
    "position_source": newest("source", _BOTH), "nac_p": newest(_OPS["nac_p"], _OP), "nic_baro": known(_OPS["nic_baro"], _OP), "sil": newest(_OPS["sil"], _OP),
    **{n: newest(_VEL[n], _VELOCITY) for n in ("speed_kt", "speed_type", "vertical_rate", "nac_v")}, "velocity_subtype": newest(_VEL["subtype"], _VELOCITY),
    "track": newest(_VEL["track"], f"{_VELOCITY} AND {b(38, 3)} IN (1, 2)"), "heading": newest(_VEL["heading"], f"{_VELOCITY} AND {b(38, 3)} IN (3, 4)"),
    **{n: known(_SURF[n], _SURFACE) for n in ("ground_speed_kt", "ground_track")},
    "track_angle": known(_B50["track_angle"], reg("5,0")), "commb_tas_kt": either("true_airspeed_kt", "5,0", "5,3"),
    "commb_gs_kt": known(_B50["ground_speed_kt"], reg("5,0")), "commb_ias_kt": either("indicated_airspeed_kt", "5,3", "6,0"),
    "velocity_ts": newest(f"CASE WHEN NOT {_VELOCITY} OR ({_VEL['speed_kt']}) IS NOT NULL THEN ts END", f"{_VELOCITY} OR {_SURFACE} OR {_DYN}"),
    "selected_altitude_ft": selected(_TGT["selected_altitude_ft"], f"coalesce({_F40['mcp_altitude_ft']}, {_F40['fms_altitude_ft']})"),
    "altitude_source": selected(_TGT["altitude_source"], f"CASE {_F40['altitude_source']} WHEN 2 THEN 'MCP/FCU' WHEN 3 THEN 'FMS' WHEN 1 THEN 'Unknown' WHEN 0 THEN NULL "
                                f"ELSE CASE WHEN {_F40['mcp_altitude_ft']} IS NOT NULL THEN 'MCP/FCU' WHEN {_F40['fms_altitude_ft']} IS NOT NULL THEN 'FMS' END END"),
    "pressure_mb": selected(_TGT["pressure_mb"], _F40["pressure_mb"]),
    **{n: known(_TGT[f], _TARGET) for n, f in (("selected_heading", "selected_heading"), ("vertical_mode", "vertical_mode"), ("horizontal_mode", "horizontal_mode"),
                                               ("autopilot_engaged", "autopilot"), ("lnav", "lnav"), ("tcas_operational", "tcas"), ("sil_target", "sil"),
                                               ("nac_p_target", "nac_p"), ("nic_baro_target", "nic_baro"))},
    "vnav": turned_on(_TGT["vnav"], 1), "altitude_hold": turned_on(_TGT["altitude_hold"], 2), "approach": turned_on(_TGT["approach"], 4),
    "autopilot_ts": newest("ts", _AP),
    **{n: known(_FIELDS["4,4"][n], reg("4,4")) for n in ("wind_speed_kt", "wind_direction", "humidity", "figure_of_merit")},
    **{n: known(_FIELDS["4,5"][n], reg("4,5")) for n in ("radio_height_ft", "wind_shear", "microburst", "icing", "wake_vortex")},
    "static_temperature": either("temperature", "4,4", "4,5"), "pressure": either("pressure", "4,4", "4,5"), "turbulence": either("turbulence", "4,4", "4,5"),
    "weather_ts": newest("ts", reg("4,4", "4,5")),
    "tcas_ra_active": newest(f"CASE WHEN {_LONG} THEN coalesce(NOT ({_DF16['ra_terminated']}), false) ELSE {_TGT['ra_active']} END",
                             f"{_LONG} OR ({_TARGET} AND ({_TGT['ra_active']}) IS NOT NULL)"),
    "sensitivity": newest(_DF0["sensitivity"], f"{_SHORT} OR {_LONG}"), "cross_link": newest(_DF0["cross_link"], _SHORT),
    "reply_information": newest(_DF0["reply_information"], f"{_SHORT} OR {_LONG}"),
    **{n: newest(_DF16[n], _LONG) for n in ("ra_terminated", "multiple_threat", "not_below", "not_above", "not_left", "not_right")},
    "acas_ts": newest("ts", f"{_SHORT} OR {_LONG} OR {_TARGET}"),
    "transponder_level": newest(b(6, 3), of("all_call")),
    **{n: newest(_OPS[f], _CLASS) for n, f in (("tcas_capability", "tcas"), ("cockpit_display", "cdti"), ("es1090", "es1090"), ("air_referenced", "arv"),
                                               ("target_reporting", "ts_report"), ("trajectory_level", "tc_level"), ("uat978", "uat"), ("position_offset", "poa"),
                                               ("low_power", "b2_low"), ("nac_v_report", "nac_v"), ("nic_c", "nic_c"))},
    **{n: known(_OPS[n], _OP) for n in ("length_m", "width_m", "gva", "nic_a", "sil_supplement", "hrd", "heading_type")},
    "datalink_bits": newest(_FIELDS["1,0"]["capability_bits"], reg("1,0")), "register_mask": newest(_FIELDS["1,7"]["register_mask"], reg("1,7")),
    **{n: newest(_OPS[f], _MODE) for n, f in (("ra_active_mode", "ra_active"), ("ident_active", "ident"), ("atc_services", "atc"), ("single_antenna", "antenna"),
                                              ("design_assurance", "sda"), ("gps_lateral_m", "gps_lateral_m"), ("gps_longitudinal_m", "gps_longitudinal_m"))},
    "downlink_request": newest(b(9, 5), of("comm_b")), "utility_message": newest(b(14, 6), of("comm_b")),
    "capabilities_ts": newest("ts", f"{_OP} OR {of('all_call')} OR {reg('1,0', '1,7')}"),
    "quality_ts": newest("ts", f"{_OP} OR {_TARGET}"),
    "roll": known(_B50["roll"], reg("5,0")), "track_rate": known(_B50["track_rate"], reg("5,0")),
    "magnetic_heading": either("magnetic_heading", "5,3", "6,0"), "mach": either("mach", "5,3", "6,0"),
    "baro_rate": either("", "5,3", "6,0", names=("vertical_rate", "baro_rate")), "inertial_rate": known(_FIELDS["6,0"]["inertial_rate"], reg("6,0")),
    "dynamics_ts": newest("ts", _DYN),
    "signal": newest("signal", "true"), "had_mlat": f"coalesce(bool_or(source = 'Mlat') FILTER ({_BOTH}), false)",
    "total_messages": "count(*)", "position_messages": f"count(*) FILTER ({_BOTH})", "velocity_messages": f"count(*) FILTER ({_VELOCITY})",
    "identification_messages": f"count(*) FILTER ({of('identification')})", "first_seen": "min(ts)", "last_seen": "max(ts)",
    "seen_seconds": "(max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6", "seen_pos_seconds": f"(max(epoch_us(ts)) - max(epoch_us(ts)) FILTER ({_BOTH})) / 1e6",
}
DOUBLES = ("ground_track", "track", "heading", "track_angle", "selected_heading", "pressure_mb", "wind_direction", "humidity", "static_temperature", "pressure", "roll",
           "track_rate", "magnetic_heading", "mach", "signal", "seen_seconds", "seen_pos_seconds", "width_m")
_SHOWN = [f"round({n}, 6) AS {n}" if n in DOUBLES else n for n in FIELDS]
FULL_STATE = f"""WITH RECURSIVE {_STATES}, st AS (SELECT icao_raw, session, {', '.join(f'{sql} AS {n}' for n, sql in FIELDS.items())} FROM msg GROUP BY icao_raw, session),
    spot AS (SELECT icao_raw, session, clat, clon, last FROM pos QUALIFY row_number() OVER (PARTITION BY icao_raw, session ORDER BY rn DESC) = 1),
    high AS (SELECT icao_raw, session, baro_ft, geo_ft, delta_ft FROM hist JOIN (SELECT frame_id, icao_raw, session, delta_ft FROM h2) USING (frame_id, icao_raw, session)
      QUALIFY row_number() OVER (PARTITION BY icao_raw, session ORDER BY ts DESC, frame_id DESC) = 1)
    SELECT icao_raw, session, upper(lpad(to_hex(icao_raw), 6, '0')) AS icao, {', '.join(_SHOWN)}, round(clat, 6) AS lat, round(clon, 6) AS lon,
      make_timestamp(last) AS position_ts, baro_ft, geo_ft, delta_ft FROM st LEFT JOIN spot USING (icao_raw, session) LEFT JOIN high USING (icao_raw, session)"""


def flat(state):
    """All fields of a state as columns; ``icao`` once, and without those that only weather computes."""
    out = ["icao_raw", "session", "icao"]
    for section in state.columns[3:]:
        for field in state.schema[section].dataType.fields:
            if field.name not in ("icao", "total_temperature", "true_heading", "magnetic_declination"):
                name = f"{section}.`{field.name}`"
                kind = field.dataType.simpleString()
                out.append(f"cast({name} AS timestamp_ntz) AS `{field.name}`" if kind == "timestamp" else f"round({name}, 6) AS `{field.name}`" if kind == "double" else name)
    return state.selectExpr(*out)


@query("full_state", FULL_STATE)
def full_state_query(spark, folder):
    """Every field of every section of every track."""
    rows = messages(spark, folder)
    return flat(aircraft.aircraft_state(rows, positions(rows)))


def replayed(spark, folder, transform, pieces: int = 3):
    """The frames, in order of time, as a stream of ``pieces`` micro-batches run to its end into a table in the shared folder."""
    base = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    # Frames are derived once; their bounds and pieces are read from what was written.
    heard(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{base}/frames")
    rows = spark.read.parquet(f"{base}/frames")
    low, high = rows.selectExpr("min(unix_micros(ts))", "max(unix_micros(ts))").first()
    with settings(spark):
        for i in range(pieces):
            part = rows.where(f"floor({pieces} * cast(unix_micros(ts) - {low or 0} AS double) / {(high or 0) - (low or 0) + 1}) = {i}")
            # Small files, since a task takes whole ones.
            part.write.mode("append").option("maxRecordsPerFile", 100_000).parquet(f"{base}/in/{i}")
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true")
        out = None
        for i in range(pieces):  # a file source takes files by age; one run per folder keeps them in order of time
            out = transform(streaming.with_event_time(source.parquet(f"{base}/in/[0-{i}]"), "ts", "1 second"))
            run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            run.awaitTermination()
        return spark.read.schema(StructType(out.schema.fields)).parquet(f"{base}/out")


@query("stream_state", FULL_STATE)
def stream_state_query(spark, folder):
    """The same fields from a stream: of every track the row after its last message."""
    out = replayed(spark, folder, lambda frames: streaming.state_stream(frames, **CHAIN))
    columns = [c for c in out.columns if c not in aircraft.TRACK]
    last = out.groupBy(*aircraft.TRACK).agg(F.max_by(F.struct(*columns), "status.total_messages").alias("s"))
    return flat(last.select(*aircraft.TRACK, "s.*"))


def _stream_history(kind):
    def run(spark, folder):
        out = replayed(spark, folder, lambda frames: streaming.track_stream(frames, history=kind, **CHAIN))
        out = out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        kept = {"position": ["lat", "lon", "nac_p"], "altitude": ["altitude_ft", "altitude_type"]}[kind]
        return rounded(out.select(*aircraft.TRACK, "kind", "seq", "ts", "frame_id", *kept), *[c for c in ("lat", "lon") if c in kept])

    return run


for _kind in ("position", "altitude"):
    query(f"stream_{_kind}_history", ORACLES[f"{_kind}_history"])(_stream_history(_kind))
