"""Captured frames with known contents."""

import pytest
from pyspark.sql import functions as F

from skytally.operators import decode, frames, positions

# frame, address, kind, register, expected fields
GOLDEN = [
    ("02E619988C620A", "4BCE08", "air_air_short", None, {"altitude_ft": 40000, "sensitivity": 7}),
    ("200016900AA153", "49D414", "altitude_reply", None, {"altitude_ft": 35000, "flight_status": 0}),
    ("28000A19336C48", "80073B", "identity_reply", None, {"squawk": "3205"}),
    ("28000C0221EAC1", "49D414", "identity_reply", None, {"squawk": "1420"}),
    ("80E1999758CD83316C74FAAD5783", "80073B", "air_air_long", None, {"altitude_ft": 39975}),
    ("8D89642D00B9800000000019A3F8", "89642D", "no_position", None, {}),
    ("8D471DBC235DA6B4DF68207B883F", "471DBC", "identification", None, {"callsign": "WZZ476", "category": 43}),
    ("8D8964A025541171E328200F47FC", "8964A0", "identification", None, {"callsign": "UAE182", "category": 45}),
    ("8D80073B58CD7331C27497A8A51D", "80073B", "airborne_position", None, {"altitude_ft": 39975, "cpr_odd": 0}),
    ("8D80073B58CD76ACC858A13FCFEF", "80073B", "airborne_position", None, {"cpr_lat": 87652, "cpr_lon": 22689}),
    ("8D73806C60C183A66876B238EC28", "73806C", "airborne_position", None,
     {"cpr_lat": 119604, "cpr_lon": 30386, "altitude_ft": 37600}),
    ("8D4BB02799156713588002997917", "4BB027", "velocity", None, {"speed_kt": 389, "vertical_rate": -1984}),
    ("8D3C4AD7990D6617F004B54E6FF0", "3C4AD7", "velocity", None, {"speed_kt": 404, "vertical_rate": 0}),
    ("8D4D2407E1129300000000BC60A0", "4D2407", "status", None, {"squawk": "6415", "emergency": 0}),
    ("8D86E778EA40885D293F8C2BCA06", "86E778", "target_state", None, {"subtype": 1, "autopilot": True, "vnav": True}),
    ("8D471DBCF82300030049B80B70D7", "471DBC", "operational_status", None, {"version": 2, "hrd": 0}),
    ("A000183A10030A80FD0000953220", "407D44", "comm_b", "1,0", {"altitude_ft": 38050}),
    ("A000183AFFFD7734600CE94FECFA", "407D44", "comm_b", "5,0",
     {"track_angle": 302.87109375, "ground_speed_kt": 418, "true_airspeed_kt": 466}),
    ("A8000A192010C237D7582024F33E", "3C4AD7", "comm_b", "2,0", {"callsign": "DLH755"}),
    ("A8000F8BFFF56B3D6004DC538855", "4BC890", "comm_b", "5,0",
     {"track_angle": 121.81640625, "ground_speed_kt": 490, "true_airspeed_kt": 440}),
    ("A0000638FA81C10000000081A92F", "484CB8", "comm_b", "1,7", {"register_mask": 0xFA81C1}),
    ("A000083E202CC371C31DE0AA1CCF", "484163", "comm_b", "2,0", {"callsign": "KLM1017"}),
    ("A8001EBCAEE57730A80106DE1344", "48548E", "comm_b", "4,0",
     {"mcp_altitude_ft": 24000, "fms_altitude_ft": 24000, "pressure_mb": 1013.2}),
    ("A80006ACF9363D3BBF9CE98F1E1D", "4008B4", "comm_b", "5,0",
     {"roll": -9.66796875, "track_angle": 140.2734375, "ground_speed_kt": 476, "track_rate": -0.40625, "true_airspeed_kt": 466}),
    ("A80004AAA74A072BFDEFC1D5CB4F", "4CA53F", "comm_b", "6,0", {"baro_rate": -2144, "inertial_rate": -2016}),
    ("A0001692185BD5CF400000DFC696", "3C4DD7", "comm_b", "4,4",
     {"wind_speed_kt": 22, "wind_direction": 344.53125, "temperature": -48.75}),
    ("A0001838E519F33160240142D7FA", "3C674D", "comm_b", "6,0", {"indicated_airspeed_kt": 249, "mach": 0.788}),
    ("A8001EBCFFFB23286004A73F6A5B", "48548E", "comm_b", "5,0", {"track_angle": 250.48828125}),
]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "frame_id long, frame string")


def test_every_golden_frame_decodes(spark):
    rows = decode.decode_messages(frames.validate_frames(table(spark, [g[0] for g in GOLDEN])))
    found = {r["frame"]: r.asDict(recursive=True) for r in rows.collect()}
    assert len(found) == len(GOLDEN)
    for frame, icao, kind, register, fields in GOLDEN:
        row = found[frame]
        assert (row["icao"], row["msg_type"], row["bds"]) == (icao, kind, register), frame
        values = {**row[kind], **(row.get(decode.register_column(register)) or {} if register else {})}
        for name, expected in fields.items():
            assert values[name] == pytest.approx(expected), (frame, name)


def test_all_call_with_interrogator_code_is_rejected(spark):
    df = table(spark, ["5D471F878D70C4"])
    assert [r["crc"] for r in frames.with_crc(df).collect()] == [0x27]
    assert frames.validate_frames(df).count() == 0


def test_any_single_wrong_bit_is_repaired(spark):
    good = "8D80073B58CD7331C27497A8A51D"
    value = int(good, 16)
    # The first five bits are the format, which decides how the frame is checked.
    broken = [f"{value ^ 1 << (111 - i):028X}" for i in range(5, 112)]
    out = frames.validate_frames(table(spark, broken)).collect()
    assert len(out) == 107
    assert {(r["frame"], r["was_corrected"]) for r in out} == {(good, True)}


def test_short_frame_repair(spark):
    # An all-call reply with a clean remainder, one bit flipped at each place after the format.
    body = 0x5D471F87 << 24
    crc = frames.with_crc(table(spark, [f"{body:014X}"])).collect()[0]["crc"]
    good = body | crc
    broken = [f"{good ^ 1 << (55 - i):014X}" for i in range(5, 56)]
    out = frames.validate_frames(table(spark, broken)).collect()
    assert {(r["frame"], r["icao"], r["was_corrected"]) for r in out} == {(f"{good:014X}", "471F87", True)}
    assert len(out) == 51


def test_frames_of_wrong_length_are_dropped(spark):
    assert frames.validate_frames(table(spark, ["8D80073B58CD7331C27497", "02E619988C620A"])).count() == 1


PAIRS = [
    ("8D80073B58CD7331C27497A8A51D", "8D80073B58CD76ACC858A13FCFEF", (46.79155, 19.56042), (46.79226, 19.55793)),
    ("8D73806C60C183A66876B238EC28", "8D73806C60C1871F9C5A043E868F", (47.47504, 20.08644), (47.47649, 20.08442)),
]


@pytest.mark.parametrize("even,odd,even_place,odd_place", PAIRS)
def test_position_pairs(spark, even, odd, even_place, odd_place):
    for texts, place in (((odd, even), even_place), ((even, odd), odd_place)):
        rows = table(spark, texts).selectExpr("*", "timestamp_seconds(1700000000 + frame_id) AS ts")
        decoded = decode.decode_airborne_position(frames.validate_frames(rows))
        paired = positions.pair_latest(decoded, "icao", "cpr_odd", "ts", ["cpr_lat", "cpr_lon"], order=["ts", "frame_id"])
        out = {r["frame_id"]: r for r in positions.decode_airborne_cpr(paired).collect()}
        assert out[0]["lat"] is None  # one half alone gives no position
        assert out[1]["lat"] == pytest.approx(place[0], abs=1e-5)
        assert out[1]["lon"] == pytest.approx(place[1], abs=1e-5)


def test_pair_ten_seconds_apart_is_too_old(spark):
    rows = table(spark, [PAIRS[0][0], PAIRS[0][1]]).selectExpr("*", "timestamp_seconds(1700000000 + frame_id * 10) AS ts")
    decoded = decode.decode_airborne_position(frames.validate_frames(rows))
    paired = positions.pair_latest(decoded, "icao", "cpr_odd", "ts", ["cpr_lat", "cpr_lon"], order=["ts"])
    assert paired.where("paired").count() == 0


def encode_surface(lat, lon, odd):
    """Inverse of the surface decoder, for the round trip."""
    step = 90.0 / (59 if odd else 60)
    zone = max(59 - int(abs(lat) / 1.5), 1)
    yz = round((lat / step % 1) * 131072) % 131072
    xz = round((lon / (90.0 / zone) % 1) * 131072) % 131072
    return yz, xz


@pytest.mark.parametrize("lat,lon", [(46.9, 19.7), (-33.94, 151.18), (51.47, -0.46), (-22.8, -43.25)])
def test_surface_round_trip_in_all_hemispheres(spark, lat, lon):
    rows = [(odd, *encode_surface(lat, lon, odd)) for odd in (0, 1)]
    df = spark.createDataFrame(rows, "cpr_odd int, cpr_lat int, cpr_lon int")
    for r in positions.decode_surface_cpr(df, lat + 0.1, lon - 0.1).collect():
        assert (r["lat"], r["lon"]) == (pytest.approx(lat, abs=0.01), pytest.approx(lon, abs=0.01))


def test_surface_without_receiver_gives_null(spark):
    df = spark.createDataFrame([(0, 1000, 2000)], "cpr_odd int, cpr_lat int, cpr_lon int")
    assert positions.decode_surface_cpr(df).select("lat", "lon").collect() == [(None, None)]


def test_gray_altitude_rule():
    table_ = decode.altitude_table()
    known = [f for f in table_ if f != decode.NO_ALTITUDE]
    assert min(known) >= -1200 and max(known) == 126700
    assert table_[0] == decode.NO_ALTITUDE


def test_fan_of_kinds_is_exclusive(spark):
    rows = decode.classify(frames.validate_frames(table(spark, [g[0] for g in GOLDEN])))
    assert rows.where(F.col("msg_type").isNull()).count() == 0
