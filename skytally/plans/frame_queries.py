"""Operators run on frames derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally.functions.units import best_speed
from skytally.operators import aircraft, decode, frames, history, listing
from skytally.operators.ordered import ROWS_PER_SLICE, split_hot_keys
from skytally.operators.positions import (
    decode_airborne_cpr,
    decode_surface_cpr,
    expire_pairs,
    pair_latest,
    range_guard,
)
from skytally.operators.tracks import enrich
from skytally.operators.weather import derived_weather, track_weather
from skytally.plans.catalog import query, table
from skytally.plans.derive import RECEIVER, REGISTRY_SQL, frames_from_events, frames_sql, registry_from_customers, zones
from skytally.plans.event_queries import nm_sql
from skytally.sources import union_sources

ORDER = ["ts", "frame_id"]
R_LAT, R_LON = RECEIVER


def raw(spark, folder, share=None):
    """One frame per event, or per event of a drawn share."""
    events = table(spark, folder, "events")
    return frames_from_events(events if share is None else events.sample(share, seed=7))


def valid(spark, folder):
    return frames.validate_frames(raw(spark, folder))


def heard(spark, folder, share=None):
    """The frames with repeats: every third is heard again by its receiver 20 ms later, every fifth by another one.

    Repeats have numbers of their own below zero.
    """
    once = raw(spark, folder) if share is None else raw(spark, folder, share)
    late = "cast(timestamp_micros(unix_micros(cast(ts as timestamp)) + {0}) as timestamp_ntz)"
    copies = [("true", "frame_id", "ts", "receiver"), ("frame_id % 3 = 0", "-frame_id - 1", late.format(20_000), "receiver"),
              ("frame_id % 5 = 0", "-frame_id - 1000000000000", late.format(10_000), "'west'")]
    # Each frame is derived once and handed on as one to three rows.
    all_copies = ", ".join(f"struct({made} AS _made, {number} AS frame_id, {ts} AS ts, {receiver} AS receiver)" for made, number, ts, receiver in copies)
    own = [c for c in once.columns if c not in ("frame_id", "ts", "receiver")]
    return once.selectExpr(*own, f"inline(filter(array({all_copies}), c -> c._made))").select(*once.columns)


def balanced(rows, spark, folder, *keysets, order=ORDER, per_event: int = 1):
    """Hot keys cut into slices, in the order of the scans that follow; every event gives ``per_event`` frames at most."""
    return split_hot_keys(rows, [list(k) for k in keysets], order, rows=per_event * table(spark, folder, "events").count())


# --- check SQL building blocks ----------------------------------------------------------


def b(start: int, count: int) -> str:
    """Bits of a frame by 1-based position."""
    word, shift = ("hd", 56 - start - count + 1) if start < 33 else ("me", 88 - start - count + 1)
    return f"CAST(({word} >> {shift}) & {(1 << count) - 1} AS INT)"


def r(start: int, count: int) -> str:
    return f"CAST((me >> {56 - start - count + 1}) & {(1 << count) - 1} AS INT)"


def on(position: int) -> str:
    return f"({b(position, 1)} = 1)"


def ron(position: int) -> str:
    return f"({r(position, 1)} = 1)"


def sgn(field: str, count: int) -> str:
    return f"(CASE WHEN {field} >= {1 << (count - 1)} THEN {field} - {1 << count} ELSE {field} END)"


_SYN = ", ".join(map(str, frames.bit_syndromes(112)))
_SHORT = ", ".join(map(str, frames.bit_syndromes(56)))


def _crc(n: int) -> str:
    """Remainder as the XOR of the syndromes of all set bits."""
    chars = n // 4
    listed = _SYN if n == 112 else _SHORT
    return (f"list_reduce(list_transform(range(1, {n + 1}), lambda i: CASE WHEN (('0x' || substr(frame, CAST((i - 1) // 4 + 1 AS BIGINT), 1))::INT "
            f">> CAST(3 - (i - 1) % 4 AS INT)) & 1 = 1 THEN [{listed}][i] ELSE 0 END), lambda x, y: xor(x, y)) /* {chars} digits */")


FRAMES = frames_sql()
CHECKED = f"""{FRAMES}, chk0 AS MATERIALIZED (SELECT *, ('0x' || substr(frame, 1, 2))::INT // 8 AS df, length(frame) * 4 AS n_bits,
      CAST(CASE WHEN length(frame) = 14 THEN {_crc(56)} ELSE {_crc(112)} END AS INT) AS crc FROM frames),
    chk AS MATERIALIZED (SELECT *, df IN (11, 17, 18, 19) AS pi_mode,
      CASE WHEN n_bits = 56 THEN list_position([{_SHORT}], crc) ELSE list_position([{_SYN}], crc) END AS pos FROM chk0),
    status AS MATERIALIZED (SELECT *, CASE WHEN NOT pi_mode OR crc = 0 THEN 'valid' WHEN pos IS NOT NULL AND pos > 0 THEN 'corrected' ELSE 'invalid' END AS status FROM chk),
    fixed AS MATERIALIZED (SELECT * REPLACE (CASE WHEN status = 'corrected' THEN substr(frame, 1, CAST((pos - 1) // 4 AS BIGINT)) ||
        upper(to_hex(xor(('0x' || substr(frame, CAST((pos - 1) // 4 + 1 AS BIGINT), 1))::INT, 1 << CAST(3 - (pos - 1) % 4 AS INT)))) ||
        substr(frame, CAST((pos - 1) // 4 + 2 AS BIGINT)) ELSE frame END AS frame) FROM status WHERE status <> 'invalid'),
    v AS MATERIALIZED (SELECT *, CASE WHEN pi_mode THEN ('0x' || substr(frame, 3, 6))::INT ELSE crc END AS icao_raw,
      ('0x' || substr(frame, 1, 14))::BIGINT AS hd, ('0x' || substr(rpad(frame, 28, '0'), 9, 14))::BIGINT AS me FROM fixed)"""
#: The same on the frames with repeats.
HEARD = CHECKED.replace("frames AS MATERIALIZED (", "once AS MATERIALIZED (", 1).replace(", chk0 AS", """, frames AS MATERIALIZED (SELECT * FROM once
    UNION ALL SELECT * REPLACE (-frame_id - 1 AS frame_id, ts + to_microseconds(20000) AS ts) FROM once WHERE frame_id % 3 = 0
    UNION ALL SELECT * REPLACE (-frame_id - 1000000000000 AS frame_id, ts + to_microseconds(10000) AS ts, 'west' AS receiver) FROM once WHERE frame_id % 5 = 0), chk0 AS""", 1)
ES = "df IN (17, 18, 19)"
TC = b(33, 5)


def chars(start: int) -> str:
    alphabet = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_ !\"#$%&''()*+,-./0123456789:;<=>?"
    return " || ".join(f"substr('{alphabet}', {b(start + 6 * i, 6)} + 1, 1)" for i in range(8))


def gillham(c: str) -> str:
    """Hundreds of feet by the XOR-table form of the code."""

    def x(pairs):
        out = "0"
        for bit, mask in pairs:
            out = f"xor({out}, CASE WHEN ({c}) & {bit} <> 0 THEN {mask} ELSE 0 END)"
        return out

    ones = x([(0x1000, 7), (0x400, 3), (0x100, 1)])
    fives = x([(4, 255), (1, 127), (0x800, 63), (0x200, 31), (0x80, 15), (0x20, 7), (8, 3), (2, 1)])
    one = f"(CASE WHEN ({ones}) & 5 = 5 THEN xor({ones}, 2) ELSE {ones} END)"
    return (f"(CASE WHEN ({c}) & 5376 <> 0 AND {one} BETWEEN 1 AND 5 THEN (({fives}) * 5 + CASE WHEN ({fives}) & 1 = 1 THEN 6 - {one} "
            f"ELSE {one} END - 13) * 100 END)")


def alt13(c: str) -> str:
    n = f"((({c}) & 8064) >> 2) | ((({c}) & 32) >> 1) | (({c}) & 15)"
    return (f"(CASE WHEN {c} = 0 THEN NULL WHEN ({c}) & 64 <> 0 THEN CAST(round_even((({c}) & 4095) / 0.3048::DOUBLE, 0) AS INT) "
            f"WHEN ({c}) & 16 <> 0 THEN ({n}) * 25 - 1000 ELSE {gillham(c)} END)")


def alt12(c: str, geometric: str) -> str:
    n = f"((({c}) & 4064) >> 1) | (({c}) & 15)"
    wide = f"(((({c}) & 4032) << 1) | (({c}) & 63))"
    return (f"(CASE WHEN {c} = 0 THEN NULL WHEN {geometric} THEN CAST(round_even(({c}) / 0.3048::DOUBLE, 0) AS INT) "
            f"WHEN ({c}) & 16 <> 0 THEN ({n}) * 25 - 1000 ELSE {gillham(wide)} END)")


def sqk(c: str) -> str:
    def digit(*ps):
        return "(" + " + ".join(f"(((({c}) >> {p}) & 1) * {w})" for p, w in zip(ps, (4, 2, 1))) + ")"

    return " || ".join(f"CAST({d} AS VARCHAR)" for d in (digit(7, 9, 11), digit(1, 3, 5), digit(8, 10, 12), digit(0, 2, 4)))


def rows_sql(where: str, **columns: str) -> str:
    return f"WITH {CHECKED} SELECT frame_id, " + ", ".join(f"{sql} AS {n}" for n, sql in columns.items()) + f" FROM v WHERE {where}"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def only(df, sql_columns):
    return df.select("frame_id", *sql_columns)


# --- frames -----------------------------------------------------------------------------


@query("frame_header", f"WITH {CHECKED} SELECT frame_id, df, CAST(n_bits // 8 AS INT) AS n_bytes, CAST(n_bits AS INT) AS n_bits, pi_mode FROM chk")
def header_query(spark, folder):
    return frames.with_frame_header(raw(spark, folder)).select("frame_id", "df", "n_bytes", "n_bits", "pi_mode")


@query("frame_crc", f"WITH {CHECKED} SELECT frame_id, crc FROM chk")
def crc_query(spark, folder):
    return frames.with_crc(raw(spark, folder)).select("frame_id", "crc")


@query("validate_frames", f"WITH {CHECKED} SELECT frame_id, frame, df, icao_raw, upper(lpad(to_hex(icao_raw), 6, '0')) AS icao, "
                          "status = 'corrected' AS was_corrected FROM v")
def validate_query(spark, folder):
    return valid(spark, folder).select("frame_id", "frame", "df", "icao_raw", "icao", "was_corrected")


@query("correct_single_bit", f"WITH {CHECKED} SELECT frame_id, frame, icao_raw FROM v WHERE status = 'corrected'")
def correct_query(spark, folder):
    return frames.correct_single_bit(raw(spark, folder)).select("frame_id", "frame", "icao_raw")


_GATED = """g AS (SELECT *, lag(ts) OVER w AS p FROM v WINDOW w AS (PARTITION BY icao_raw ORDER BY ts, frame_id)),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 30000000 THEN 1 ELSE 0 END)
          OVER (PARTITION BY icao_raw ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS ses FROM g),
    det AS (SELECT *, row_number() OVER (PARTITION BY icao_raw, ses ORDER BY ts, frame_id) AS detections FROM s)"""


@query("validation_stats", f"""WITH {HEARD}, {_GATED}, again AS (SELECT *, lag(CASE WHEN detections >= 5 THEN ts END) OVER (PARTITION BY icao_raw, frame ORDER BY ts, frame_id) AS dp FROM det), c AS (SELECT count(*) AS checked, count(*) FILTER (status = 'valid') AS valid,
      count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (status = 'invalid') AS invalid FROM status)
    SELECT *, (SELECT count(*) FROM det WHERE detections < 5) AS unconfident,
      (SELECT count(*) FROM again WHERE detections >= 5 AND epoch_us(ts) - epoch_us(dp) <= 50000) AS duplicate,
      round(valid * 100.0::DOUBLE / checked, 1) AS valid_rate, round(corrected * 100.0::DOUBLE / checked, 1) AS corrected_rate,
      round(invalid * 100.0::DOUBLE / checked, 1) AS invalid_rate FROM c""")
def validation_stats_query(spark, folder):
    return frames.validation_stats(heard(spark, folder), n=5, order=ORDER, rows_per_slice=ROWS_PER_SLICE)


@query("frame_gate", f"WITH {CHECKED}, {_GATED} SELECT frame_id, icao_raw, detections FROM det WHERE detections >= 5")
def frame_gate_query(spark, folder):
    rows = balanced(valid(spark, folder), spark, folder, ["icao_raw"])
    return frames.confidence_gate(rows, "icao_raw", "ts", 5, order=ORDER).select(
        "frame_id", "icao_raw", "detections")


@query("receiver_dedup", f"""WITH {FRAMES}, two AS (SELECT frame_id, frame, ts, 'Sdr' AS source FROM frames UNION ALL
      SELECT frame_id, frame, ts + to_microseconds(CAST(20000 + (frame_id % 3) * 20000 AS BIGINT)), 'Beast' FROM frames),
    l AS (SELECT *, lag(ts) OVER (PARTITION BY frame ORDER BY ts, source) AS p FROM two)
    SELECT frame_id, ts, source FROM l WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 50000""")
def receiver_dedup_query(spark, folder):
    one = raw(spark, folder).select("frame_id", "frame", "ts")
    late = one.withColumn("ts", F.expr("cast(timestamp_micros(unix_micros(cast(ts as timestamp)) + 20000 + (frame_id % 3) * 20000) as timestamp_ntz)"))
    order = ["ts", "source"]
    both = balanced(union_sources({"Sdr": one, "Beast": late}), spark, folder, ["frame"], order=order, per_event=2)
    return frames.dedup_within(both, "frame", "ts", order=order).select("frame_id", "ts", "source")


# --- decoding ---------------------------------------------------------------------------

_RI = f"{b(14, 4)} IN (0, 2, 3, 4, 8, 9, 10, 11, 12, 13, 14)"
_EAST = f"(({b(47, 10)} - 1) * CASE WHEN {b(38, 3)} IN (2, 4) THEN 4 ELSE 1 END * CASE WHEN {on(46)} THEN -1 ELSE 1 END)"
_NORTH = f"(({b(58, 10)} - 1) * CASE WHEN {b(38, 3)} IN (2, 4) THEN 4 ELSE 1 END * CASE WHEN {on(57)} THEN -1 ELSE 1 END)"
_GROUND_OK = (f"({b(38, 3)} IN (1, 2) AND {b(47, 10)} <> 0 AND {b(58, 10)} <> 0 AND floor(sqrt({_EAST}::DOUBLE * {_EAST} + {_NORTH}::DOUBLE * {_NORTH})) <= 4096)")
_KIND = f"""CASE WHEN {ES} AND {TC} BETWEEN 1 AND 4 THEN 'identification' WHEN {ES} AND ({TC} BETWEEN 9 AND 18 OR {TC} BETWEEN 20 AND 22) THEN 'airborne_position'
    WHEN {ES} AND {TC} BETWEEN 5 AND 8 AND ({b(38, 7)} <= 24 OR {b(38, 7)} IN (124, 127)) THEN 'surface_position'
    WHEN {ES} AND {TC} = 19 AND ({_GROUND_OK} OR {b(38, 3)} IN (3, 4)) THEN 'velocity' WHEN {ES} AND {TC} = 28 AND {b(38, 3)} <= 2 THEN 'status'
    WHEN {ES} AND {TC} = 31 AND {b(38, 3)} <= 1 AND {b(73, 3)} <= 2 THEN 'operational_status'
    WHEN {ES} AND {TC} = 29 AND ({b(38, 2)} = 1 OR ({b(38, 2)} = 0 AND {b(46, 2)} <= 2 AND {b(70, 2)} <= 2)) THEN 'target_state'
    WHEN {ES} AND {TC} = 0 THEN 'no_position' WHEN df = 0 AND {_RI} THEN 'air_air_short' WHEN df = 16 AND {_RI} THEN 'air_air_long'
    WHEN df = 4 THEN 'altitude_reply' WHEN df = 5 THEN 'identity_reply' WHEN df = 11 THEN 'all_call' WHEN df IN (20, 21) THEN 'comm_b' END"""


@query("classify", f"WITH {CHECKED} SELECT frame_id, CASE WHEN {ES} THEN {TC} END AS tc, {_KIND} AS msg_type FROM v")
def classify_query(spark, folder):
    return decode.classify(valid(spark, folder)).select("frame_id", "tc", "msg_type")


@query("payload_bits", rows_sql("n_bits = 112", first=r(1, 8), middle=r(20, 17), last=r(45, 12)))
def payload_query(spark, folder):
    rows = decode.with_words(valid(spark, folder).where("n_bits = 112"))
    return rows.selectExpr("frame_id", *[f"{decode.register_bits(s, n)} AS {c}" for s, n, c in
                                         ((1, 8, "first"), (20, 17, "middle"), (45, 12, "last"))])


_CAT = f"({TC} * 10 + {b(38, 3)})"
_IDENT = dict(callsign=f"rtrim({chars(41)})",
              category=f"CASE WHEN {_CAT} IN (10, 21, 23, 31, 32, 33, 40, 41, 42, 43, 44, 45, 46, 47) THEN {_CAT} ELSE 0 END")


@query("decode_identification", rows_sql(f"{ES} AND {TC} BETWEEN 1 AND 4", **_IDENT))
def identification_query(spark, folder):
    return only(decode.decode_identification(valid(spark, folder)), _IDENT)


_GEO = f"{TC} BETWEEN 20 AND 22"
_AIR = dict(surveillance_status=b(38, 2), antenna=b(40, 1), altitude_ft=alt12(b(41, 12), _GEO),
            altitude_type=f"CASE WHEN {_GEO} THEN 'Geometric' ELSE 'Barometric' END", cpr_odd=b(54, 1), cpr_lat=b(55, 17), cpr_lon=b(72, 17))


@query("decode_airborne_position", rows_sql(f"{ES} AND ({TC} BETWEEN 9 AND 18 OR {_GEO})", **_AIR))
def airborne_query(spark, folder):
    return only(decode.decode_airborne_position(valid(spark, folder)), _AIR)


@query("gray_altitude", f"""WITH {CHECKED}, c AS (SELECT frame_id, (hd >> 24) & 8191 AS code FROM v)
    SELECT frame_id, {alt13('code')} AS altitude_ft, CASE WHEN code & 80 = 0 THEN {gillham('code')} // 100 END AS gray_hundreds FROM c""")
def gray_query(spark, folder):
    """All frames' 13-bit fields through the altitude table and the Gray code of codes that are one."""
    from skytally.functions.bits import int_array_sql

    rows = valid(spark, folder).selectExpr("frame_id", "cast((shiftright(cast(conv(substring(frame, 1, 14), 16, 10) as bigint), 24) & 8191) as int) AS code")
    feet = f"nullif(get({int_array_sql(decode.altitude_table())}, code), {decode.NO_ALTITUDE})"
    return rows.selectExpr("frame_id", f"{feet} AS altitude_ft", f"CASE WHEN code & 80 = 0 THEN cast({feet} / 100 as int) END AS gray_hundreds")


_MOVE = "CASE {m} " + " ".join(f"WHEN {c} THEN {k}" for c, k in decode.MOVEMENT_KNOTS.items()) + " END"
_SURF = dict(movement=b(38, 7), ground_speed_kt=_MOVE.format(m=b(38, 7)), ground_track=f"CASE WHEN {on(45)} THEN {b(46, 7)} * (360.0::DOUBLE / 128) END",
             cpr_odd=b(54, 1), cpr_lat=b(55, 17), cpr_lon=b(72, 17))


@query("decode_surface_position", rows_sql(f"{_KIND} = 'surface_position'", **_SURF))
def surface_query(spark, folder):
    return only(decode.decode_surface_position(valid(spark, folder)), _SURF)


_G = f"{b(38, 3)} IN (1, 2)"
_SCALE = f"CASE WHEN {b(38, 3)} = 4 THEN 4 ELSE 1 END"
_VEL = dict(
    subtype=b(38, 3),
    speed_kt=f"CASE WHEN {_G} THEN CAST(floor(sqrt({_EAST}::DOUBLE * {_EAST} + {_NORTH}::DOUBLE * {_NORTH})) AS INT) WHEN {b(58, 10)} <> 0 THEN ({b(58, 10)} - 1) * {_SCALE} END",
    speed_type=f"CASE WHEN {_G} THEN 'GroundSpeed' WHEN {b(58, 10)} = 0 THEN NULL WHEN {on(57)} THEN 'TrueAirspeed' ELSE 'IndicatedAirspeed' END",
    track=f"CASE WHEN {_G} THEN round(fmod(fmod(atan2({_EAST}, {_NORTH}) * 180 / pi(), 360) + 360, 360), 6) END",
    heading=f"CASE WHEN NOT {_G} AND {on(46)} AND {b(47, 10)} <> 0 THEN {b(47, 10)} * 360.0::DOUBLE / 1024 END",
    vertical_rate=f"CASE WHEN {b(70, 9)} <> 0 THEN ({b(70, 9)} - 1) * 64 * CASE WHEN {on(69)} THEN -1 ELSE 1 END END",
    nac_v=b(43, 3),
    geo_delta=f"CASE WHEN {b(82, 7)} NOT IN (0, 127) THEN ({b(82, 7)} - 1) * 25 * CASE WHEN {on(81)} THEN -1 ELSE 1 END END")


@query("decode_velocity", rows_sql(f"{_KIND} = 'velocity'", **_VEL))
def velocity_query(spark, folder):
    return rounded(only(decode.decode_velocity(valid(spark, folder)), _VEL), "track")


@query("decode_velocity_ground", rows_sql(f"{_KIND} = 'velocity' AND {_G}", **{k: _VEL[k] for k in ("speed_kt", "track")}))
def velocity_ground_query(spark, folder):
    return rounded(decode.decode_velocity_ground(valid(spark, folder)).select("frame_id", "speed_kt", "track"), "track")


@query("decode_velocity_air", rows_sql(f"{_KIND} = 'velocity' AND NOT {_G}", **{k: _VEL[k] for k in ("speed_kt", "heading", "speed_type")}))
def velocity_air_query(spark, folder):
    return decode.decode_velocity_air(valid(spark, folder)).select("frame_id", "speed_kt", "heading", "speed_type")


@query("decode_vertical_rate", rows_sql(f"{_KIND} = 'velocity'", **{k: _VEL[k] for k in ("vertical_rate", "geo_delta")}))
def vertical_query(spark, folder):
    return decode.decode_velocity(valid(spark, folder)).select("frame_id", "vertical_rate", "geo_delta")


_STAT = dict(subtype=b(38, 3), emergency=f"CASE WHEN {b(38, 3)} = 1 THEN {b(41, 3)} END",
             squawk=f"CASE WHEN {b(38, 3)} = 1 AND {b(44, 13)} <> 0 THEN {sqk(b(44, 13))} END")


@query("decode_status", rows_sql(f"{_KIND} = 'status'", **_STAT))
def status_query(spark, folder):
    return only(decode.decode_status(valid(spark, folder)), _STAT)


_SF, _AB, _V = f"{b(38, 3)} = 1", f"{b(38, 3)} = 0", b(73, 3)
_CC, _OM = f"{b(41, 2)} = 0", f"{b(57, 2)} = 0"
_L = f"{_V} >= 1"
_AL, _GL, _MD = f"({_L} AND {_AB} AND {_CC})", f"({_L} AND {_SF} AND {_CC})", f"({_L} AND {_OM})"


def c(condition, value):
    return f"CASE WHEN {condition} THEN {value} END"


_OPS = dict(
    subtype=b(38, 3), version=_V, has_capability=f"({_V} = 0 OR {_AL} OR {_GL})", tcas=c(f"{_AB} AND {_CC}", on(43)),
    cdti=c(f"{_V} = 0 AND {_AB} AND {_CC}", on(44)), es1090=c(f"{_AL} OR {_GL}", on(44)), arv=c(_AL, on(47)), ts_report=c(_AL, on(48)),
    tc_level=c(_AL, b(49, 2)), uat=f"CASE WHEN {_AL} THEN {on(51)} WHEN {_GL} THEN {on(48)} END", poa=c(_GL, on(43)), b2_low=c(_GL, on(47)),
    nac_v=c(_GL, b(49, 3)), nic_c=c(_GL, on(52)), has_mode=_MD, ra_active=c(_MD, on(59)), ident=c(_MD, on(60)), atc=c(_MD, on(61)),
    antenna=c(_MD, b(62, 1)), sda=c(_MD, b(63, 2)),
    gps_lateral_m=c(f"{_MD} AND {_SF}", f"CASE {b(65, 3)} WHEN 1 THEN -2 WHEN 2 THEN -4 WHEN 3 THEN -6 WHEN 5 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN 6 ELSE 0 END"),
    gps_longitudinal_m=c(f"{_MD} AND {_SF}", f"{b(68, 5)} * 2"),
    length_m=c(f"{_L} AND {_SF}", f"CASE WHEN {b(53, 4)} = 0 THEN 0 WHEN {b(53, 4)} = 1 THEN 15 ELSE {b(53, 4)} // 2 * 10 + 15 END"),
    width_m=c(f"{_L} AND {_SF}", f"[0, 23, 28.5, 34, 33, 38, 39.5, 45, 45, 52, 59.5, 67, 72.5, 80, 80, 90][{b(53, 4)} + 1]::DOUBLE"),
    nic_a=c(_L, on(86)), nac_p=c(_L, b(77, 4)), gva=c(f"{_L} AND {_AB}", b(81, 2)), sil=c(_L, b(83, 2)), nic_baro=c(f"{_L} AND {_AB}", b(85, 1)),
    heading_type=c(f"{_L} AND {_SF}", b(85, 1)), hrd=c(_L, b(86, 1)), sil_supplement=c(f"{_V} = 2", b(87, 1)))


@query("decode_operational_status", rows_sql(f"{_KIND} = 'operational_status'", **_OPS))
def operation_query(spark, folder):
    return only(decode.decode_operational_status(valid(spark, folder)), _OPS)


_T1, _T2 = f"{b(38, 2)} = 0", f"{b(38, 2)} = 1"
_M2 = f"{_T2} AND {on(79)}"
_TGT = dict(
    subtype=b(38, 2),
    selected_altitude_ft=f"CASE WHEN {_T1} AND {b(40, 2)} <> 0 THEN -1000 + {b(48, 10)} * 100 WHEN {_T2} AND {b(42, 11)} <> 0 THEN ({b(42, 11)} - 1) * 32 END",
    altitude_source=f"CASE WHEN {_T1} THEN ['MCP/FCU', 'Holding Mode', 'FMS/RNAV'][CASE WHEN {b(40, 2)} = 0 THEN 9 ELSE {b(40, 2)} END] WHEN {on(41)} THEN 'FMS' ELSE 'MCP/FCU' END",
    selected_heading=f"CASE WHEN {_T1} AND {b(58, 2)} <> 0 THEN {b(60, 9)} * (360.0::DOUBLE / 512) WHEN {_T2} AND {on(62)} THEN {b(63, 9)} * (180.0::DOUBLE / 256) END",
    heading_type=c(f"{_T1} AND {b(58, 2)} <> 0", b(69, 1)), pressure_mb=c(f"{_T2} AND {b(53, 9)} <> 0", f"round(800 + ({b(53, 9)} - 1) * 0.8::DOUBLE, 6)"),
    vertical_mode=c(_T1, b(46, 2)), horizontal_mode=c(_T1, b(70, 2)), autopilot=c(_M2, on(80)), vnav=c(_M2, on(81)), altitude_hold=c(_M2, on(82)),
    approach=c(_M2, on(84)), lnav=c(_T2, on(86)), tcas=f"CASE WHEN {_T1} THEN {b(84, 1)} = 0 ELSE {on(85)} END", ra_active=c(_T1, on(85)),
    emergency=c(_T1, b(86, 3)), sil=b(77, 2), nac_p=b(72, 4), nic_baro=b(76, 1))


@query("decode_target_state", rows_sql(f"{_KIND} = 'target_state'", **_TGT))
def target_query(spark, folder):
    return rounded(only(decode.decode_target_state(valid(spark, folder)), _TGT), "pressure_mb")


_DF0 = dict(on_ground=on(6), cross_link=on(7), sensitivity=b(9, 3), reply_information=b(14, 4), altitude_ft=alt13(b(20, 13)))
_RAC = f"{b(33, 8)} = 48"
_DF16 = dict(on_ground=on(6), sensitivity=b(9, 3), reply_information=b(14, 4), altitude_ft=alt13(b(20, 13)), acas_valid=f"({_RAC})",
             not_below=c(_RAC, on(55)), not_above=c(_RAC, on(56)), not_left=c(_RAC, on(57)), not_right=c(_RAC, on(58)),
             ra_terminated=c(_RAC, on(59)), multiple_threat=c(_RAC, on(60)))
_DF4 = dict(flight_status=b(6, 3), altitude_ft=alt13(b(20, 13)))
_DF5 = dict(flight_status=b(6, 3), squawk=sqk(b(20, 13)))
_DF11 = dict(capability=b(6, 3), announced_icao="substr(frame, 3, 6)")

for _name, _where, _columns, _decoder in (
    ("decode_df0", f"df = 0 AND {_RI}", _DF0, decode.decode_df0), ("decode_df16", f"df = 16 AND {_RI}", _DF16, decode.decode_df16),
    ("decode_df4", "df = 4", _DF4, decode.decode_df4), ("decode_df5", "df = 5", _DF5, decode.decode_df5),
    ("decode_df11", "df = 11", _DF11, decode.decode_df11),
):
    query(_name, rows_sql(_where, **_columns))(
        lambda spark, folder, _f=_decoder, _c=_columns: only(_f(valid(spark, folder)), _c))

# Registers: guard and fields in the check engine, each tried in the fixed order.
_B50 = dict(roll=f"{sgn(r(2, 10), 10)} * (45.0::DOUBLE / 256)", track_angle=f"fmod({sgn(r(13, 11), 11)} * (90.0::DOUBLE / 512) + 360, 360)",
            ground_speed_kt=f"{r(25, 10)} * 2", true_airspeed_kt=f"{r(47, 10)} * 2", track_rate=c(ron(35), f"{sgn(r(36, 10), 10)} * (8.0::DOUBLE / 256)"))
_T44 = f"((CASE WHEN {ron(24)} THEN {r(25, 10)} - 1024 ELSE {r(25, 10)} END) * 0.25::DOUBLE)"
_VR53 = f"(CASE WHEN {r(49, 8)} IN (0, 255) THEN 0 ELSE (CASE WHEN {ron(48)} THEN -{r(49, 8)} ELSE {r(49, 8)} END) * 64 END)"
_P40 = f"(800.0::DOUBLE + {r(28, 12)} * 0.1::DOUBLE)"
_M40, _F40, _Q40 = f"({ron(1)} AND {r(2, 12)} <> 0)", f"({ron(14)} AND {r(15, 12)} <> 0)", f"({ron(27)} AND {r(28, 12)} <> 0)"
_C20 = f"trim({chars(41)})"
_LOW32 = "(me & 4294967295)"
_GUARDS = {
    "1,0": f"{r(1, 8)} = 16 AND {r(10, 5)} = 0 AND CASE WHEN {ron(15)} THEN {r(17, 7)} >= 5 ELSE {r(17, 7)} <= 4 END",
    "2,0": f"{r(1, 8)} = 32 AND (me & 281474976710655 = 0 OR NOT contains({_C20}, '#') OR {_C20} = '########')",
    "3,0": f"{r(1, 8)} = 48 AND {r(29, 2)} <> 3 AND {r(16, 7)} < 48",
    "1,7": f"{_LOW32} = 0 AND {ron(7)}",
    "4,0": f"{r(40, 8)} = 0 AND {r(52, 2)} = 0 AND ({_M40} OR {_F40} OR {_Q40} OR {ron(48)} OR {ron(54)}) AND NOT ({_Q40} AND {_P40} > 1200)",
    "5,0": f"{ron(1)} AND {ron(12)} AND {ron(24)} AND {ron(46)} AND abs({_B50['roll']}) <= 50 AND abs({r(25, 10)} * 2 - {r(47, 10)} * 2) <= 200 "
           f"AND NOT ({ron(35)} AND abs({sgn(r(36, 10), 10)} * (8.0::DOUBLE / 256)) > 10)",
    "6,0": f"{ron(1)} AND {ron(13)} AND {ron(24)} AND ({ron(35)} OR {ron(46)}) AND {r(14, 10)} <= 500 AND {r(25, 10)} * 0.004::DOUBLE <= 1 "
           f"AND NOT ({ron(35)} AND abs({sgn(r(36, 10), 10)} * 32) > 6000) AND NOT ({ron(46)} AND abs({sgn(r(47, 10), 10)} * 32) > 6000)",
    "4,4": f"{r(1, 4)} <= 4 AND CASE WHEN {ron(5)} THEN {r(6, 9)} <= 250 ELSE {r(6, 9)} = 0 AND {r(15, 9)} = 0 END AND {_T44} BETWEEN -80 AND 60 "
           f"AND ({ron(35)} OR {r(36, 11)} = 0) AND ({ron(47)} OR {r(48, 2)} = 0) AND ({ron(50)} OR {r(51, 6)} = 0)",
    "4,5": f"{r(52, 5)} = 0 AND ({ron(1)} OR {ron(4)} OR {ron(7)} OR {ron(10)} OR {ron(13)} OR {ron(16)} OR {ron(27)} OR {ron(39)}) "
           f"AND NOT ({ron(16)} AND {sgn(r(17, 10), 10)} * 0.25::DOUBLE NOT BETWEEN -80 AND 60) AND NOT ({ron(27)} AND {r(28, 11)} NOT BETWEEN 100 AND 1200) "
           f"AND NOT ({ron(39)} AND {r(40, 12)} * 16 > 5000)",
    "5,3": f"({ron(1)} OR {ron(13)} OR {ron(24)} OR {ron(34)} OR {ron(47)}) AND NOT ({ron(13)} AND {r(14, 10)} > 500) "
           f"AND NOT ({ron(24)} AND {r(25, 9)} * 0.008::DOUBLE > 1) AND NOT ({ron(34)} AND {r(35, 12)} // 2 > 500) AND NOT ({ron(47)} AND abs({_VR53}) > 8000)",
}
_FIELDS = {
    "1,0": dict(capability_bits=r(9, 16)),
    "1,7": dict(register_mask="me >> 32"),
    "2,0": dict(callsign=f"CASE WHEN me & 281474976710655 = 0 THEN '' ELSE {_C20} END"),
    "4,0": dict(mcp_altitude_ft=c(_M40, f"{r(2, 12)} * 16"), fms_altitude_ft=c(_F40, f"{r(15, 12)} * 16"), pressure_mb=c(_Q40, f"round({_P40}, 6)"),
                nav_modes=c(ron(48), r(49, 3)), altitude_source=c(ron(54), r(55, 2))),
    "4,4": dict(figure_of_merit=r(1, 4), wind_speed_kt=c(ron(5), r(6, 9)), wind_direction=c(ron(5), f"{r(15, 9)} * (180.0::DOUBLE / 256)"), temperature=_T44,
                pressure=c(ron(35), f"{r(36, 11)}::DOUBLE"), turbulence=c(ron(47), r(48, 2)), humidity=c(ron(50), f"{r(51, 6)} * (100.0::DOUBLE / 64)")),
    "4,5": dict(turbulence=c(ron(1), r(2, 2)), wind_shear=c(ron(4), r(5, 2)), microburst=c(ron(7), r(8, 2)), icing=c(ron(10), r(11, 2)), wake_vortex=c(ron(13), r(14, 2)),
                temperature=c(ron(16), f"{sgn(r(17, 10), 10)} * 0.25::DOUBLE"), pressure=c(ron(27), f"{r(28, 11)}::DOUBLE"), radio_height_ft=c(ron(39), f"{r(40, 12)} * 16")),
    "5,0": _B50,
    "5,3": dict(magnetic_heading=c(ron(1), f"{r(2, 11)} * (90.0::DOUBLE / 512)"), indicated_airspeed_kt=c(ron(13), r(14, 10)), mach=c(ron(24), f"round({r(25, 9)} * 0.008::DOUBLE, 6)"),
                true_airspeed_kt=c(ron(34), f"{r(35, 12)} // 2"), vertical_rate=c(ron(47), _VR53)),
    "6,0": dict(magnetic_heading=f"{r(2, 11)} * (90.0::DOUBLE / 512)", indicated_airspeed_kt=r(14, 10), mach=f"round({r(25, 10)} * 0.004::DOUBLE, 6)",
                baro_rate=c(ron(35), f"{sgn(r(36, 10), 10)} * 32"), inertial_rate=c(ron(46), f"{sgn(r(47, 10), 10)} * 32")),
}
_BDS = ("CASE WHEN me = 0 THEN 'Empty' " + " ".join(f"WHEN {_GUARDS[k]} THEN '{k}'" for k in decode.REGISTER_ORDER) + " ELSE 'Unknown' END")
_CAND = ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN me <> 0 AND {_GUARDS[k]} THEN '{k}' END" for k in decode.REGISTER_ORDER)
         + "], lambda x: x IS NOT NULL), ' ')")
_REGS = f"{CHECKED}, reg AS MATERIALIZED (SELECT *, {_BDS} AS bds, {_CAND} AS bds_candidates FROM v WHERE df IN (20, 21))"


@query("infer_register", f"WITH {_REGS} SELECT frame_id, bds, bds_candidates FROM reg")
def infer_query(spark, folder):
    return decode.infer_register(valid(spark, folder)).select("frame_id", "bds", "bds_candidates")


@query("decode_df20_df21", f"WITH {_REGS} SELECT frame_id, {b(6, 3)} AS flight_status, {b(9, 5)} AS downlink_request, {b(14, 6)} AS utility_message, "
                           f"CASE WHEN df = 20 THEN {alt13(b(20, 13))} END AS altitude_ft, CASE WHEN df = 21 THEN {sqk(b(20, 13))} END AS squawk, bds FROM reg")
def commb_query(spark, folder):
    return decode.decode_df20_df21(valid(spark, folder)).select(
        "frame_id", "flight_status", "downlink_request", "utility_message", "altitude_ft", "squawk", "bds")


def _register_query(code):
    floats = [n for n in ("mach", "pressure_mb") if n in _FIELDS[code]]

    def run(spark, folder):
        out = decode.decode_register(valid(spark, folder), code).select("frame_id", *_FIELDS[code])
        return rounded(out, *floats) if floats else out

    return run


for _code, _columns in _FIELDS.items():
    query("register_" + _code.replace(",", ""),
          f"WITH {_REGS} SELECT frame_id, " + ", ".join(f"{s} AS {n}" for n, s in _columns.items()) + f" FROM reg WHERE bds = '{_code}'")(_register_query(_code))


@query("register_30", f"WITH {_REGS} SELECT frame_id FROM reg WHERE bds = '3,0'")
def register_30_query(spark, folder):
    return decode.decode_register(valid(spark, folder), "3,0").select("frame_id")


@query("message_breakdown", f"""WITH {CHECKED}, k AS (SELECT df, CASE WHEN {ES} THEN {TC} END AS tc, CASE WHEN df IN (20, 21) THEN {_BDS} END AS bds FROM v),
    u AS (SELECT 'df' AS breakdown, CAST(df AS VARCHAR) AS code FROM k UNION ALL SELECT 'tc', CAST(tc AS VARCHAR) FROM k WHERE tc IS NOT NULL
          UNION ALL SELECT 'bds', bds FROM k WHERE bds IS NOT NULL), n AS (SELECT breakdown, code, count(*) AS messages FROM u GROUP BY ALL)
    SELECT *, round(messages * 100.0::DOUBLE / sum(messages) OVER (PARTITION BY breakdown), 6) AS percent FROM n""")
def breakdown_query(spark, folder):
    return decode.message_breakdown(valid(spark, folder)).withColumn("percent", F.round("percent", 6))


# --- positions --------------------------------------------------------------------------

_PW = "OVER (PARTITION BY icao_raw ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING)"
_PAIRS = f"""ap AS MATERIALIZED (SELECT frame_id, icao_raw, ts, {b(54, 1)} AS odd, {b(55, 17)} AS la, {b(72, 17)} AS lo FROM v
      WHERE {ES} AND ({TC} BETWEEN 9 AND 18 OR {TC} BETWEEN 20 AND 22)),
    pr AS (SELECT *, last_value(CASE WHEN odd = 0 THEN {{'t': ts, 'la': la, 'lo': lo}} END IGNORE NULLS) {_PW} AS e,
      last_value(CASE WHEN odd = 1 THEN {{'t': ts, 'la': la, 'lo': lo}} END IGNORE NULLS) {_PW} AS o FROM ap),
    p1 AS (SELECT *, e.la / 131072.0::DOUBLE AS ela, e.lo / 131072.0::DOUBLE AS elo, o.la / 131072.0::DOUBLE AS ola, o.lo / 131072.0::DOUBLE AS olo,
      coalesce(abs(epoch_us(e.t) - epoch_us(o.t)) < 60000000, false) AS paired, coalesce(o.t > e.t, false) AS use_odd FROM pr),
    p2 AS (SELECT *, CAST(floor(59 * ela - 60 * ola + 0.5) AS BIGINT) AS j FROM p1),
    p3 AS (SELECT *, 6.0::DOUBLE * ((j % 60 + 60) % 60 + ela) AS a0, (360.0::DOUBLE / 59) * ((j % 59 + 59) % 59 + ola) AS a1 FROM p2),
    p4 AS (SELECT *, CASE WHEN a0 >= 270 THEN a0 - 360 ELSE a0 END AS lat0, CASE WHEN a1 >= 270 THEN a1 - 360 ELSE a1 END AS lat1 FROM p3),
    p5 AS (SELECT *, {zones('lat0')} AS n0, {zones('lat1')} AS n1 FROM p4),
    p6 AS (SELECT *, greatest(n0 - CASE WHEN use_odd THEN 1 ELSE 0 END, 1) AS ni, CAST(floor(elo * (n0 - 1) - olo * n0 + 0.5) AS BIGINT) AS m,
      paired AND lat0 BETWEEN -90 AND 90 AND lat1 BETWEEN -90 AND 90 AND n0 = n1 AS good FROM p5),
    p7 AS (SELECT *, 360.0::DOUBLE / ni * ((m % ni + ni) % ni + CASE WHEN use_odd THEN olo ELSE elo END) AS x FROM p6),
    p8 AS MATERIALIZED (SELECT frame_id, icao_raw, ts, paired, CASE WHEN good THEN CASE WHEN use_odd THEN lat1 ELSE lat0 END END AS lat,
      CASE WHEN good THEN CASE WHEN x > 180 THEN x - 360 ELSE x END END AS lon FROM p7)"""


def pairs(spark, folder):
    rows = balanced(decode.decode_airborne_position(valid(spark, folder)), spark, folder, ["icao_raw"])
    return pair_latest(rows, "icao_raw", "cpr_odd", "ts", ["cpr_lat", "cpr_lon"], "60 seconds", ORDER)


@query("airborne_cpr", f"WITH {CHECKED}, {_PAIRS} SELECT frame_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM p8 WHERE paired")
def cpr_query(spark, folder):
    return rounded(decode_airborne_cpr(pairs(spark, folder)).where("paired").select("frame_id", "lat", "lon"), "lat", "lon")


_NEAR = f"coalesce({nm_sql(R_LAT, R_LON, 'lat', 'lon')} <= 300, false)"


@query("range_guard", f"""WITH {CHECKED}, {_PAIRS} SELECT frame_id, CASE WHEN {_NEAR} THEN round(lat, 6) END AS lat,
    CASE WHEN {_NEAR} THEN round(lon, 6) END AS lon FROM p8 WHERE paired""")
def guard_query(spark, folder):
    rows = range_guard(decode_airborne_cpr(pairs(spark, folder)), R_LAT, R_LON)
    return rounded(rows.where("paired").select("frame_id", "lat", "lon"), "lat", "lon")


@query("surface_cpr", f"""WITH {CHECKED}, s0 AS (SELECT frame_id, CASE WHEN {b(54, 1)} = 0 THEN 90.0::DOUBLE / 60 ELSE 90.0::DOUBLE / 59 END AS dlat,
      {b(55, 17)} / 131072.0::DOUBLE AS yz, {b(72, 17)} / 131072.0::DOUBLE AS xz FROM v WHERE {_KIND} = 'surface_position'),
    s1 AS (SELECT *, dlat * (floor({R_LAT} / dlat) + floor(0.5 + fmod({R_LAT}, dlat) / dlat - yz) + yz) AS lat FROM s0),
    s2 AS (SELECT *, 90.0::DOUBLE / greatest(59 - floor(abs(lat) / 1.5::DOUBLE), 1) AS dlon FROM s1)
    SELECT frame_id, round(lat, 6) AS lat, round(dlon * (floor({R_LON} / dlon) + floor(0.5 + fmod({R_LON}, dlon) / dlon - xz) + xz), 6) AS lon FROM s2""")
def surface_cpr_query(spark, folder):
    rows = decode.decode_surface_position(valid(spark, folder))
    return rounded(decode_surface_cpr(rows, R_LAT, R_LON).select("frame_id", "lat", "lon"), "lat", "lon")


@query("waiting_pairs", f"""WITH {CHECKED}, {_PAIRS}, l AS (SELECT *, row_number() OVER (PARTITION BY icao_raw ORDER BY ts DESC, frame_id DESC) AS rn FROM p1)
    SELECT icao_raw, ts AS waiting_since FROM l WHERE rn = 1 AND NOT paired AND epoch_us(TIMESTAMP '2024-01-01 00:12:00') - epoch_us(ts) <= 60000000""")
def waiting_query(spark, folder):
    out = expire_pairs(pairs(spark, folder), "icao_raw", ORDER, F.expr("timestamp_ntz '2024-01-01 00:12:00'"), "1 minute")
    return out.select("icao_raw", "waiting_since")


# --- the whole chain --------------------------------------------------------------------


def messages(spark, folder, fields=None):
    """Settled: what is asked of the messages reads them two or three times. Hot keys are looked for on frames of drawn events."""
    return aircraft.received_messages(heard(spark, folder), confidence=5, track_timeout="120 seconds", rows_per_slice=ROWS_PER_SLICE, settle=True,
                                      rows=3 * table(spark, folder, "events").count(), sample=lambda share: heard(spark, folder, share), fields=fields)


def positions(rows):
    return aircraft.track_positions(rows, RECEIVER, "60 seconds", "120 seconds")


_MLAT_GATE = """g AS (SELECT *, lag(ts) OVER w AS p, CASE WHEN source = 'Mlat' THEN 'Sdr' ELSE source END AS grp FROM v
      WINDOW w AS (PARTITION BY icao_raw, CASE WHEN source = 'Mlat' THEN 'Sdr' ELSE source END ORDER BY ts, frame_id)),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 30000000 THEN 1 ELSE 0 END)
          OVER (PARTITION BY icao_raw, grp ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS ses FROM g),
    passed AS (SELECT * FROM (SELECT *, sum(CASE WHEN source = 'Mlat' THEN 5 ELSE 1 END)
          OVER (PARTITION BY icao_raw, grp, ses ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS detections FROM s) WHERE detections >= 5),
    det AS (SELECT * FROM (SELECT *, lag(ts) OVER (PARTITION BY icao_raw, receiver, frame, source = 'Sdr' ORDER BY ts, frame_id) AS dp FROM passed)
          WHERE source <> 'Sdr' OR dp IS NULL OR epoch_us(ts) - epoch_us(dp) > 50000)"""
_RECEIVED = f"""{HEARD}, {_MLAT_GATE}, msg0 AS MATERIALIZED (SELECT *, {_KIND} AS msg_type, CASE WHEN df IN (20, 21) THEN {_BDS} END AS bds FROM det),
    msg1 AS (SELECT *, lag(ts) OVER (PARTITION BY icao_raw ORDER BY ts, frame_id) AS pt FROM msg0 WHERE msg_type IS NOT NULL),
    msg AS MATERIALIZED (SELECT *, CAST(sum(CASE WHEN pt IS NULL OR epoch_us(ts) - epoch_us(pt) > 120000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY icao_raw ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM msg1)"""


@query("received_messages", f"WITH {_RECEIVED} SELECT frame_id, icao_raw, session, msg_type, bds FROM msg")
def received_query(spark, folder):
    return messages(spark, folder).select("frame_id", "icao_raw", "session", "msg_type", "bds")


_O = "(ts, frame_id)"
_CALL = f"(msg_type = 'identification' OR (bds = '2,0' AND me & 281474976710655 <> 0 AND {_C20} <> ''))"


_LISTED = f"""WITH {_RECEIVED}, {REGISTRY_SQL}, st AS (SELECT icao_raw, session,
      (arg_max({{'v': CASE WHEN msg_type = 'identification' THEN rtrim({chars(41)}) ELSE {_C20} END}}, {_O}) FILTER ({_CALL})).v AS callsign,
      (arg_max({{'v': CASE WHEN msg_type = 'identity_reply' THEN {sqk(b(20, 13))} ELSE {sqk(b(44, 13))} END}}, {_O})
        FILTER (msg_type = 'identity_reply' OR (msg_type = 'status' AND {b(38, 3)} = 1 AND {b(44, 13)} <> 0))).v AS squawk,
      arg_max({_IDENT['category']}, {_O}) FILTER (msg_type = 'identification') AS category,
      arg_max(msg_type = 'surface_position', {_O}) FILTER (msg_type IN ('surface_position', 'airborne_position')) AS on_ground,
      (arg_max({{'v': {_VEL['speed_kt']}}}, {_O}) FILTER (msg_type = 'velocity')).v AS speed_kt,
      (arg_max({{'v': {_VEL['vertical_rate']}}}, {_O}) FILTER (msg_type = 'velocity')).v AS vertical_rate,
      arg_max({_SURF['ground_speed_kt']}, {_O}) FILTER (msg_type = 'surface_position' AND {_SURF['ground_speed_kt']} IS NOT NULL) AS ground_speed_kt,
      arg_max(CASE WHEN df IN (0, 4, 16) THEN {alt13(b(20, 13))} ELSE {alt12(b(41, 12), 'false')} END, {_O}) FILTER (
        (msg_type IN ('altitude_reply', 'air_air_short', 'air_air_long') AND {alt13(b(20, 13))} IS NOT NULL)
        OR (msg_type = 'airborne_position' AND {TC} <= 18 AND {alt12(b(41, 12), 'false')} IS NOT NULL)) AS baro_altitude_ft,
      count(*) AS total_messages, max(ts) AS last_seen FROM msg GROUP BY icao_raw, session),
    cur AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY icao_raw ORDER BY session DESC) = 1)
    SELECT upper(lpad(to_hex(icao_raw), 6, '0')) AS icao, callsign, squawk, category, on_ground, speed_kt, vertical_rate, ground_speed_kt,
      baro_altitude_ft, total_messages, last_seen, registration, military FROM cur
    LEFT JOIN registry r ON r.icao = upper(lpad(to_hex(icao_raw), 6, '0'))"""


@query("aircraft_list", _LISTED)
def aircraft_list_query(spark, folder):
    state = aircraft.current_tracks(aircraft.aircraft_state(messages(spark, folder)))
    registry = registry_from_customers(table(spark, folder, "customer"))
    listed = listing.aircraft_list(state.join(registry.drop("country"), "icao", "left"))
    return listed.select("icao", "callsign", "squawk", "category", "on_ground", "speed_kt", "vertical_rate", "ground_speed_kt",
                         "baro_altitude_ft", "total_messages", "last_seen", "registration", "military")


def _as_of(value: str, when: str | None = None) -> str:
    """Running value in a track: newest row with ``when`` (nulls count), or newest known value."""
    over = "OVER (PARTITION BY icao_raw, session ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING)"
    if when is None:
        return f"last_value({value} IGNORE NULLS) {over}"
    return f"(last_value(CASE WHEN {when} THEN {{'v': {value}}} END IGNORE NULLS) {over}).v"


_TRACKED = f"""{_RECEIVED}, {_PAIRS.replace('FROM v', 'FROM msg')},
    near AS (SELECT frame_id, CASE WHEN paired AND {_NEAR} THEN lat END AS lat, CASE WHEN paired AND {_NEAR} THEN lon END AS lon FROM p8),
    s0 AS (SELECT frame_id, CASE WHEN {b(54, 1)} = 0 THEN 90.0::DOUBLE / 60 ELSE 90.0::DOUBLE / 59 END AS dlat,
      {b(55, 17)} / 131072.0::DOUBLE AS yz, {b(72, 17)} / 131072.0::DOUBLE AS xz FROM msg WHERE msg_type = 'surface_position'),
    s1 AS (SELECT *, dlat * (floor({R_LAT} / dlat) + floor(0.5 + fmod({R_LAT}, dlat) / dlat - yz) + yz) AS lat FROM s0),
    s2 AS (SELECT *, 90.0::DOUBLE / greatest(59 - floor(abs(lat) / 1.5::DOUBLE), 1) AS dlon FROM s1),
    ground AS (SELECT frame_id, lat, dlon * (floor({R_LON} / dlon) + floor(0.5 + fmod({R_LON}, dlon) / dlon - xz) + xz) AS lon FROM s2),
    spd AS (SELECT *, {_as_of(_VEL['speed_kt'], "msg_type = 'velocity'")} AS air_speed FROM msg),
    tp AS MATERIALIZED (SELECT q.frame_id, q.icao_raw, q.session, q.ts, epoch_us(q.ts) AS us, q.msg_type = 'surface_position' AS surf, q.air_speed,
      coalesce(n.lat, g.lat) AS lat, coalesce(n.lon, g.lon) AS lon, row_number() OVER (PARTITION BY q.icao_raw ORDER BY q.ts, q.frame_id) AS rn
      FROM spd q LEFT JOIN near n USING (frame_id) LEFT JOIN ground g USING (frame_id) WHERE q.msg_type IN ('airborne_position', 'surface_position')),
    fold AS (SELECT DISTINCT icao_raw, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS BIGINT) AS session, CAST(NULL AS DOUBLE) AS clat,
        CAST(NULL AS DOUBLE) AS clon, CAST(NULL AS BIGINT) AS last, 0 AS rejects, false AS accepted FROM tp
      UNION ALL
      SELECT icao_raw, rn, frame_id, session, CASE WHEN surf THEN coalesce(lat, pl) WHEN lat IS NULL THEN pl WHEN ok THEN lat WHEN rej >= 4 THEN NULL ELSE pl END,
        CASE WHEN surf THEN coalesce(lon, po) WHEN lat IS NULL THEN po WHEN ok THEN lon WHEN rej >= 4 THEN NULL ELSE po END,
        CASE WHEN surf THEN us WHEN lat IS NULL THEN plast WHEN ok THEN CASE WHEN pl IS DISTINCT FROM lat OR po IS DISTINCT FROM lon THEN us ELSE plast END
             WHEN rej >= 4 THEN us ELSE plast END,
        CASE WHEN surf OR lat IS NULL THEN rej WHEN ok OR rej >= 4 THEN 0 ELSE rej + 1 END, lat IS NOT NULL AND (surf OR ok)
      FROM (SELECT *, pl IS NULL OR plast IS NULL OR us - plast > 60000000
              OR {nm_sql('pl', 'po', 'lat', 'lon')} <= ((us - plast) / 1e6 + 1) * coalesce(air_speed, 900) / 3600 AS ok
            FROM (SELECT tp.*, CASE WHEN f.session = tp.session THEN clat END AS pl, CASE WHEN f.session = tp.session THEN clon END AS po,
                CASE WHEN f.session = tp.session THEN last END AS plast, CASE WHEN f.session = tp.session THEN rejects ELSE 0 END AS rej
              FROM fold f JOIN tp ON tp.icao_raw = f.icao_raw AND tp.rn = f.rn + 1))),
    pos AS MATERIALIZED (SELECT * FROM fold WHERE rn > 0)"""


@query("track_positions", f"""WITH RECURSIVE {_TRACKED} SELECT frame_id, icao_raw, session, accepted, rejects AS rejections, last AS position_us,
    round(clat, 6) AS track_lat, round(clon, 6) AS track_lon FROM pos""")
def track_positions_query(spark, folder):
    out = positions(messages(spark, folder))
    return rounded(out.select("frame_id", "icao_raw", "session", "accepted", "rejections", "position_us", "track_lat", "track_lon"),
                   "track_lat", "track_lon")


_T = "PARTITION BY icao_raw, session ORDER BY ts, frame_id"
_BARO = f"CASE WHEN msg_type = 'airborne_position' AND {TC} <= 18 THEN {alt12(b(41, 12), 'false')} END"
_GEOM = f"CASE WHEN msg_type = 'airborne_position' AND {TC} >= 20 THEN {alt12(b(41, 12), 'true')} END"
_REPLY = f"CASE WHEN msg_type IN ('altitude_reply', 'air_air_short', 'air_air_long') THEN {alt13(b(20, 13))} END"
_IS_V = "msg_type = 'velocity'"
_STATES = f"""{_TRACKED},
    h0 AS MATERIALIZED (SELECT m.*, pos.frame_id IS NOT NULL AS fixed, clat, clon, {_BARO} AS baro, {_GEOM} AS geom, {_REPLY} AS reply,
      CASE WHEN {_IS_V} THEN {_VEL['geo_delta']} END AS dlt FROM msg m LEFT JOIN pos USING (icao_raw, frame_id, session)),
    h1 AS (SELECT *, {_as_of('coalesce(baro, reply)')} AS baro_ft FROM h0),
    h2 AS (SELECT *, {_as_of('CASE WHEN geom IS NOT NULL AND baro_ft IS NOT NULL THEN geom - baro_ft ELSE dlt END')} AS delta_ft FROM h1),
    hist AS MATERIALIZED (SELECT icao_raw, session, ts, frame_id, {_as_of('clat', 'fixed')} AS lat, {_as_of('clon', 'fixed')} AS lon, baro_ft,
      {_as_of('CASE WHEN geom IS NOT NULL THEN geom WHEN baro + delta_ft BETWEEN -2000 AND 126700 THEN baro + delta_ft END')} AS geo_ft,
      {_as_of(_OPS['nac_p'], "msg_type = 'operational_status'")} AS nac_p, {_as_of(_VEL['speed_kt'], _IS_V)} AS speed_kt,
      {_as_of(_VEL['speed_type'], _IS_V)} AS speed_type, {_as_of(_VEL['vertical_rate'], _IS_V)} AS vertical_rate,
      {_as_of(b(38, 3), _IS_V)} AS velocity_subtype, {_as_of(_VEL['track'], f"{_IS_V} AND {b(38, 3)} IN (1, 2)")} AS track,
      {_as_of(_VEL['heading'], f"{_IS_V} AND {b(38, 3)} IN (3, 4)")} AS heading,
      {_as_of(f"CASE WHEN msg_type = 'surface_position' THEN {_SURF['ground_speed_kt']} END")} AS ground_speed_kt,
      {_as_of(f"CASE WHEN msg_type = 'surface_position' THEN {_SURF['ground_track']} END")} AS ground_track FROM h2)"""
_ALT = "coalesce(baro_ft, geo_ft) AS altitude_ft, CASE WHEN baro_ft IS NOT NULL THEN 'Barometric' WHEN geo_ft IS NOT NULL THEN 'Geometric' END AS altitude_type"
_SPEEDS = ["speed_kt", "heading", "track", "ground_speed_kt", "ground_track", "vertical_rate"]
_PLACE = ["round(lat, 6) AS lat", "round(lon, 6) AS lon"]


def _history_sql(kind, known, judged, columns):
    row = "{" + ", ".join(f"'{j}': {j}" for j in judged) + "}"
    return f"""WITH RECURSIVE {_STATES}, a AS (SELECT *, {_ALT} FROM hist), k AS (SELECT * FROM a WHERE {known}),
        c AS (SELECT *, lag({row}) OVER ({_T}) AS before, row_number() OVER ({_T}) AS rn FROM k),
        d AS (SELECT * FROM c WHERE rn = 1 OR before IS DISTINCT FROM {row})
        SELECT icao_raw, session, '{kind}' AS kind, row_number() OVER ({_T}) AS seq, ts, frame_id, {', '.join(columns)} FROM d"""


_HISTORIES = {
    "position": _history_sql("position", "lat IS NOT NULL", ["lat", "lon"], [*_PLACE, "nac_p"]),
    "altitude": _history_sql("altitude", "altitude_ft IS NOT NULL", ["altitude_ft", "altitude_type"], ["altitude_ft", "altitude_type"]),
    "velocity": _history_sql("velocity", "speed_kt IS NOT NULL OR ground_speed_kt IS NOT NULL", [*_SPEEDS, "speed_type"],
                             [*_SPEEDS, "speed_type", "velocity_subtype"]),
    "state": _history_sql("state", "lat IS NOT NULL", ["lat", "lon"], [*_PLACE, "nac_p", "altitude_ft", "altitude_type", *_SPEEDS]),
}


def _history_query(kind):
    def run(spark, folder):
        rows = messages(spark, folder, aircraft.HISTORY_FIELDS).where(F.col("msg_type").isin(*aircraft.HISTORY_FIELDS))
        tracked = aircraft.tracked_rows(rows, positions(rows))
        out = getattr(history, f"{kind}_history")(tracked, aircraft.TRACK, ORDER)
        return rounded(out, *[c for c in ("lat", "lon", "track") if c in out.columns])

    return run


for _kind in history.KINDS:
    query(f"{_kind}_history", _HISTORIES[_kind])(_history_query(_kind))


@query("current_picture", f"""WITH RECURSIVE {_STATES}, {REGISTRY_SQL}, st AS (SELECT icao_raw, session,
      (arg_max({{'v': CASE WHEN msg_type = 'identification' THEN rtrim({chars(41)}) ELSE {_C20} END}}, {_O}) FILTER ({_CALL})).v AS callsign,
      (arg_max({{'v': CASE WHEN msg_type = 'identity_reply' THEN {sqk(b(20, 13))} ELSE {sqk(b(44, 13))} END}}, {_O})
        FILTER (msg_type = 'identity_reply' OR (msg_type = 'status' AND {b(38, 3)} = 1 AND {b(44, 13)} <> 0))).v AS squawk,
      arg_max({_IDENT['category']}, {_O}) FILTER (msg_type = 'identification') AS category,
      arg_max(msg_type = 'surface_position', {_O}) FILTER (msg_type IN ('surface_position', 'airborne_position')) AS on_ground,
      arg_max(signal, {_O}) AS signal, count(*) AS total_messages, max(ts) AS last_seen FROM msg GROUP BY icao_raw, session),
    cur AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY icao_raw ORDER BY session DESC) = 1),
    lst AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY icao_raw, session ORDER BY ts DESC, frame_id DESC) = 1)
    SELECT upper(lpad(to_hex(icao_raw), 6, '0')) AS icao, callsign, squawk, category, round(lat, 6) AS lat, round(lon, 6) AS lon,
      baro_ft AS baro_altitude_ft, geo_ft AS geo_altitude_ft, on_ground, speed_kt, track, ground_speed_kt, ground_track, vertical_rate,
      round(10 * log10(signal / 255), 6) AS signal_db, total_messages, last_seen, true AS database_enabled, registration, type_code, operator_name,
      military, ladd, pia FROM cur JOIN lst USING (icao_raw, session) LEFT JOIN registry r ON r.icao = upper(lpad(to_hex(icao_raw), 6, '0'))""")
def picture_query(spark, folder):
    """Flagship: validate, gate, de-duplicate, decode, locate, merge, enrich and rank all aircraft."""
    rows = messages(spark, folder)
    state = aircraft.current_tracks(aircraft.aircraft_state(rows, positions(rows)))
    registry = registry_from_customers(table(spark, folder, "customer"))
    listed = listing.aircraft_list(state.join(registry.drop("country"), "icao", "left"))
    return listing.rank(rounded(listed, "lat", "lon", "track", "signal_db"), "baro_altitude_ft", True)


_DETAIL = _LISTED.replace("count(*) AS total_messages,", "count(*) AS total_messages, min(ts) AS first_seen,").replace("total_messages, last_seen,", "total_messages, first_seen, last_seen,")


@query("track_detail", _DETAIL)
def detail_query(spark, folder):
    """Fields of five sections of every current track; the other sections are checked by the list and the histories."""
    state = aircraft.current_tracks(aircraft.aircraft_state(messages(spark, folder)))
    found = listing.detail(enrich(state, registry_from_customers(table(spark, folder, "customer"))))
    return found.select(
        "icao", "identification.callsign", "identification.squawk", "identification.category", "position.on_ground", "velocity_and_dynamics.speed_kt",
        "velocity_and_dynamics.vertical_rate", "velocity_and_dynamics.ground_speed_kt", F.col("position.baro_ft").alias("baro_altitude_ft"),
        "status.total_messages", "status.first_seen", "status.last_seen", "database_record.registration", "database_record.military")


@query("best_ranking", f"SELECT icao, coalesce(speed_kt, ground_speed_kt) AS best_speed FROM ({_LISTED}) ORDER BY best_speed DESC NULLS LAST, icao LIMIT 50")
def best_ranking_query(spark, folder):
    """The fifty fastest tracks by the speed in the air if known, else on the ground."""
    listed = listing.aircraft_list(aircraft.current_tracks(aircraft.aircraft_state(messages(spark, folder))))
    rows = listed.select("icao", best_speed(F.col("speed_kt"), F.col("ground_speed_kt")).alias("best_speed"))
    return listing.page(listing.rank(rows, "best_speed", descending=True), 0, 50)


def weather_inputs(rows):
    """The columns derived weather needs, as known after every message; headings count as true."""
    rules = [r for section in ("velocity", "dynamics", "position") for r in aircraft.SECTION_RULES[section]
             if r.name in ("track_angle", "track", "commb_tas_kt", "commb_gs_kt", "speed_kt", "velocity_ts", "magnetic_heading", "mach",
                           "dynamics_ts", "on_ground")]
    from skytally.operators.tracks import state_as_of

    out = state_as_of(rows, aircraft.KEY, ORDER, rules, "session")
    return out.selectExpr(
        "icao_raw", "session", "ts", "frame_id", "on_ground", "magnetic_heading AS true_heading", "coalesce(track_angle, track) AS track",
        "cast(commb_tas_kt as double) AS tas", "cast(coalesce(commb_gs_kt, speed_kt) as double) AS gs", "mach", "dynamics_ts", "velocity_ts",
        "coalesce(bds IN ('5,0', '5,3', '6,0'), false) AS computes", "coalesce(bds IN ('4,4', '4,5'), false) AS reports",
        "bds_44.wind_speed_kt AS report_wind_speed", "bds_44.wind_direction AS report_wind_direction",
        "coalesce(bds_44.temperature, bds_45.temperature) AS report_temperature")


_DYN = "bds IN ('5,0', '5,3', '6,0')"
_REP = "coalesce(bds IN ('4,4', '4,5'), false)"


def _in(code: str, name: str, value: str | None = None) -> str:
    return f"CASE WHEN bds = '{code}' THEN {value or _FIELDS[code][name]} END"


_MACH53, _MACH60 = f"CASE WHEN {ron(24)} THEN {r(25, 9)} * 0.008::DOUBLE END", f"{r(25, 10)} * 0.004::DOUBLE"
_CALC = "weather_changed AND NOT rep"


_WEATHER_CHAIN = f"""i1 AS (SELECT *, tas - cos((th - trk) * pi() / 180) * gs AS head, sin((th - trk) * pi() / 180) * gs AS side, coalesce(on_ground, false) AS down,
      CASE WHEN mach >= 0.395 THEN pow(tas / (661.47 * mach), 2) * 288.15 - 273.15 END AS oat0 FROM i0),
    i2 AS (SELECT *, CASE WHEN NOT down AND sqrt(head * head + side * side) < 250 THEN CAST(round_even(sqrt(head * head + side * side), 0) AS INT) END AS ws,
      CASE WHEN NOT down AND sqrt(head * head + side * side) < 250 THEN fmod(fmod((th * pi() / 180 + atan2(side, head)) * 180 / pi(), 360) + 360, 360) END AS wd,
      CASE WHEN NOT down AND oat0 BETWEEN -80 AND 100 THEN oat0 END AS oat FROM i1),
    i3 AS MATERIALIZED (SELECT *, (oat + 273.15) * (1 + 0.2 * mach * mach) - 273.15 AS tat0, computes AND (ws IS NOT NULL OR oat IS NOT NULL) AS may,
      row_number() OVER (PARTITION BY icao_raw ORDER BY ts, frame_id) AS rn FROM i2),
    lim AS (SELECT DISTINCT icao_raw, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS BIGINT) AS last, false AS weather_changed FROM i3
      UNION ALL SELECT icao_raw, rn, frame_id, CASE WHEN e THEN us ELSE last END, e FROM (
        SELECT i3.*, lim.last, rep OR (may AND (lim.last IS NULL OR us - lim.last >= 1000000)) AS e FROM lim JOIN i3 ON i3.icao_raw = lim.icao_raw AND i3.rn = lim.rn + 1)),
    w AS (SELECT i3.*, weather_changed FROM i3 JOIN lim USING (icao_raw, rn))
"""


@query("derived_weather", f"""WITH RECURSIVE {_RECEIVED}, i0 AS (SELECT frame_id, icao_raw, session, ts, epoch_us(ts) AS us, coalesce({_DYN}, false) AS computes, {_REP} AS rep,
      {_as_of("msg_type = 'surface_position'", "msg_type IN ('surface_position', 'airborne_position')")} AS on_ground,
      {_as_of(f"coalesce({_in('5,3', 'magnetic_heading')}, {_in('6,0', 'magnetic_heading')})")} AS th,
      coalesce({_as_of(_in('5,0', 'track_angle'))}, {_as_of(_VEL['track'].replace(', 6)', ', 12)'), f"{_IS_V} AND {b(38, 3)} IN (1, 2)")}) AS trk,
      CAST({_as_of(f"coalesce({_in('5,0', 'true_airspeed_kt')}, {_in('5,3', 'true_airspeed_kt')})")} AS DOUBLE) AS tas,
      CAST(coalesce({_as_of(_in('5,0', 'ground_speed_kt'))}, {_as_of(_VEL['speed_kt'], _IS_V)}) AS DOUBLE) AS gs,
      {_as_of(f"coalesce({_in('5,3', 'mach', _MACH53)}, {_in('6,0', 'mach', _MACH60)})")} AS mach,
      {_in('4,4', 'wind_speed_kt')} AS rws, {_in('4,4', 'wind_direction')} AS rwd,
      coalesce({_in('4,4', 'temperature')}, {_in('4,5', 'temperature')}) AS rtemp FROM msg),
    {_WEATHER_CHAIN}
    SELECT frame_id, icao_raw, weather_changed, {_as_of(f'CASE WHEN rep THEN rws WHEN {_CALC} THEN ws END')} AS wind_speed,
      round({_as_of(f'CASE WHEN rep THEN rwd WHEN {_CALC} THEN wd END')}, 4) AS wind_direction,
      round({_as_of(f'CASE WHEN rep THEN rtemp WHEN {_CALC} THEN oat END')}, 6) AS static_temperature,
      round({_as_of(f'CASE WHEN {_CALC} AND tat0 BETWEEN -80 AND 100 THEN tat0 END')}, 6) AS total_temperature FROM w""")
def weather_query(spark, folder):
    out = derived_weather(weather_inputs(messages(spark, folder)), "icao_raw", "ts", ORDER, session="session")
    return rounded(out.select("frame_id", "icao_raw", "weather_changed", "wind_speed", F.round("wind_direction", 4).alias("wind_direction"),
                              "static_temperature", "total_temperature"), "static_temperature", "total_temperature")


_MAGNETIC = _as_of(f"coalesce({_in('5,3', 'magnetic_heading')}, {_in('6,0', 'magnetic_heading')})")
_TURNED = "fmod(mag + decl + 360, 360)"
_AROUND = f"({_TURNED} - trk)"


@query("track_weather", f"""WITH RECURSIVE {_STATES}, t0 AS (SELECT m.frame_id, m.icao_raw, m.session, m.ts, epoch_us(m.ts) AS us, m.bds, coalesce({_DYN}, false) AS computes, {_REP} AS rep,
      {_as_of("msg_type = 'surface_position'", "msg_type IN ('surface_position', 'airborne_position')")} AS on_ground,
      {_MAGNETIC} AS mag, coalesce({_as_of(_in('5,0', 'track_angle'))}, {_as_of(_VEL['track'].replace(', 6)', ', 12)'), f"{_IS_V} AND {b(38, 3)} IN (1, 2)")}) AS trk,
      CAST({_as_of(f"coalesce({_in('5,0', 'true_airspeed_kt')}, {_in('5,3', 'true_airspeed_kt')})")} AS DOUBLE) AS tas,
      CAST(coalesce({_as_of(_in('5,0', 'ground_speed_kt'))}, {_as_of(_VEL['speed_kt'], _IS_V)}) AS DOUBLE) AS gs,
      {_as_of(f"coalesce({_in('5,3', 'mach', _MACH53)}, {_in('6,0', 'mach', _MACH60)})")} AS mach,
      {_in('4,4', 'wind_speed_kt')} AS rws, {_in('4,4', 'wind_direction')} AS rwd, coalesce({_in('4,4', 'temperature')}, {_in('4,5', 'temperature')}) AS rtemp FROM msg m),
    t1 AS (SELECT t0.*, (floor(lat) * 2 + floor(lon)) / 10 AS decl FROM t0 JOIN (SELECT frame_id, lat, lon FROM hist) h USING (frame_id)),
    t2 AS (SELECT *, CASE WHEN coalesce(bds IN ('5,3', '6,0'), false) AND (trk IS NULL
      OR abs(CASE WHEN {_AROUND} > 180 THEN {_AROUND} - 360 WHEN {_AROUND} < -180 THEN {_AROUND} + 360 ELSE {_AROUND} END) < 45) THEN {_TURNED} END AS turned FROM t1),
    i0 AS (SELECT *, {_as_of('turned')} AS th FROM t2), {_WEATHER_CHAIN},
    z AS (SELECT icao_raw, session, ts, frame_id, {_as_of(f'CASE WHEN rep THEN rws WHEN {_CALC} THEN ws END')} AS wind_speed_kt,
      {_as_of(f'CASE WHEN rep THEN rwd WHEN {_CALC} THEN wd END')} AS wind_direction, {_as_of(f'CASE WHEN rep THEN rtemp WHEN {_CALC} THEN oat END')} AS static_temperature,
      {_as_of(f'CASE WHEN {_CALC} AND tat0 BETWEEN -80 AND 100 THEN tat0 END')} AS total_temperature, th AS true_heading FROM w),
    e AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY icao_raw ORDER BY session DESC, ts DESC, frame_id DESC) = 1)
    SELECT upper(lpad(to_hex(icao_raw), 6, '0')) AS icao, wind_speed_kt, round(wind_direction, 4) AS wind_direction, round(static_temperature, 6) AS static_temperature,
      round(total_temperature, 6) AS total_temperature, round(true_heading, 6) AS true_heading FROM e""")
def track_weather_query(spark, folder):
    """Weather and true heading in the state of every aircraft; the declination of a cell follows a simple rule here."""
    rows = messages(spark, folder)
    places = positions(rows)
    grid = spark.range(64_800).selectExpr("cast(id div 360 as int) - 90 AS cell_lat", "cast(id % 360 as int) - 180 AS cell_lon", "2024 AS year")
    grid = grid.withColumn("declination", F.expr("(cast(cell_lat as double) * 2 + cell_lon) / 10"))
    state = aircraft.current_tracks(aircraft.aircraft_state(rows, places, weather=track_weather(rows, places, grid)))
    found = state.select("icao", "meteorology.wind_speed_kt", F.round("meteorology.wind_direction", 4).alias("wind_direction"),
                         "meteorology.static_temperature", "meteorology.total_temperature", "dynamics.true_heading")
    return rounded(found, "static_temperature", "total_temperature", "true_heading")
