"""Extended squitter payloads: identification, position, velocity, status, intent.

Every kind is a triple of SQL texts: which rows it takes, which of those decode (None for
all), and the fields they give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.bits import int_array_sql
from skytally.operators.decode.fields import (
    LENGTH_METERS,
    MOVEMENT_KNOTS,
    VALID_CATEGORIES,
    WIDTH_METERS,
    bit,
    bits,
    carried,
    feet_of_meters,
    squawk,
    text6,
    when,
    with_words,
)

EXTENDED = "df >= 17 AND df <= 19"
TYPE_CODE = "_tc"
_SUBTYPE3 = "_sub"


def _type(low: int, high: int) -> str:
    test = f"{TYPE_CODE} = {low}" if low == high else f"{TYPE_CODE} BETWEEN {low} AND {high}"
    return f"({EXTENDED} AND {test})"


def identification():
    code = f"({TYPE_CODE} * 10 + _sub)"
    return _type(1, 4), None, {
        "callsign": f"rtrim({text6(41)})",
        "category": when(f"{code} IN {VALID_CATEGORIES}", code, "0"),
    }


def airborne_position():
    geometric = f"{TYPE_CODE} BETWEEN 20 AND 22"
    return f"({_type(9, 18)} OR {_type(20, 22)})", None, {
        "surveillance_status": bits(38, 2),
        "antenna": bits(40, 1),
        "altitude_ft": when(geometric, when("_code <> 0", feet_of_meters(bits(41, 12))), "_alt"),
        "altitude_type": when(geometric, "'Geometric'", "'Barometric'"),
        "cpr_odd": bits(54, 1),
        "cpr_lat": bits(55, 17),
        "cpr_lon": bits(72, 17),
    }


def surface_position():
    movement = bits(38, 7)
    speeds = " ".join(f"WHEN {code} THEN {knots}" for code, knots in MOVEMENT_KNOTS.items())
    return _type(5, 8), f"({movement} <= 24 OR {movement} IN (124, 127))", {
        "movement": movement,
        "ground_speed_kt": f"(CASE {movement} {speeds} END)",
        "ground_track": when(bit(45), f"{bits(46, 7)} * 2.8125D"),
        "cpr_odd": bits(54, 1),
        "cpr_lat": bits(55, 17),
        "cpr_lon": bits(72, 17),
    }


def _sign(position: int) -> str:
    return when(bit(position), "-1", "1")


def vertical_rate() -> str:
    raw = bits(70, 9)
    return when(f"{raw} <> 0", f"({raw} - 1) * 64 * {_sign(69)}")


def geo_delta() -> str:
    raw = bits(82, 7)
    return when(f"{raw} NOT IN (0, 127)", f"({raw} - 1) * 25 * {_sign(81)}")


def velocity():
    ground = f"{_SUBTYPE3} IN (1, 2)"
    # Supersonic subtypes count in steps of four knots.
    scale = when(f"{_SUBTYPE3} IN (2, 4)", "4", "1")
    east_raw, north_raw = bits(47, 10), bits(58, 10)
    east = f"(({east_raw} - 1) * {scale} * {_sign(46)})"
    north = f"(({north_raw} - 1) * {scale} * {_sign(57)})"
    ground_speed = f"cast(floor(sqrt(cast({east} * {east} + {north} * {north} as double))) as int)"
    track = f"((atan2(cast({east} as double), cast({north} as double)) * 180.0D / pi() % 360.0D + 360.0D) % 360.0D)"
    known = f"({ground} AND {east_raw} <> 0 AND {north_raw} <> 0 AND {ground_speed} <= 4096)"
    air = f"{_SUBTYPE3} IN (3, 4)"
    return _type(19, 19), f"({known} OR {air})", {
        "subtype": _SUBTYPE3,
        "speed_kt": when(ground, ground_speed, when(f"{north_raw} <> 0", f"({north_raw} - 1) * {scale}")),
        "speed_type": when(ground, "'GroundSpeed'",
                           when(f"{north_raw} <> 0", when(bit(57), "'TrueAirspeed'", "'IndicatedAirspeed'"))),
        "track": when(ground, track),
        "heading": when(f"{air} AND {bit(46)} AND {east_raw} <> 0", f"{east_raw} * 360.0D / 1024.0D"),
        "vertical_rate": vertical_rate(),
        "nac_v": bits(43, 3),
        "geo_delta": geo_delta(),
    }


def status():
    urgent, identity = f"{_SUBTYPE3} = 1", bits(44, 13)
    return _type(28, 28), f"{_SUBTYPE3} <= 2", {
        "subtype": _SUBTYPE3,
        "emergency": when(urgent, bits(41, 3)),
        "squawk": when(f"{urgent} AND {identity} <> 0", squawk(identity)),
    }


def operational_status():
    """Version 0, 1 and 2 reports; bit 86 gives both the NIC supplement and the reference direction."""
    airborne, surface = f"{_SUBTYPE3} = 0", f"{_SUBTYPE3} = 1"
    version = bits(73, 3)
    later, class_set, mode_set = f"{version} IN (1, 2)", f"{bits(41, 2)} = 0", f"{bits(57, 2)} = 0"
    air_class = f"{airborne} AND {class_set}"
    air_later, ground_later = f"({later} AND {air_class})", f"({later} AND {surface} AND {class_set})"
    any_class = f"({version} = 0 OR {air_later} OR {ground_later})"
    any_mode = f"({later} AND {mode_set})"
    ground, air = f"({later} AND {surface})", f"({later} AND {airborne})"
    return _type(31, 31), f"({_SUBTYPE3} <= 1 AND {version} <= 2)", {
        "subtype": _SUBTYPE3,
        "version": version,
        "has_capability": any_class,
        "tcas": when(air_class, bit(43)),
        "cdti": when(f"{air_class} AND {version} = 0", bit(44)),
        "es1090": when(f"{air_later} OR {ground_later}", bit(44)),
        "arv": when(air_later, bit(47)),
        "ts_report": when(air_later, bit(48)),
        "tc_level": when(air_later, bits(49, 2)),
        "uat": when(air_later, bit(51), when(ground_later, bit(48))),
        "poa": when(ground_later, bit(43)),
        "b2_low": when(ground_later, bit(47)),
        "nac_v": when(ground_later, bits(49, 3)),
        "nic_c": when(ground_later, bit(52)),
        "has_mode": any_mode,
        "ra_active": when(any_mode, bit(59)),
        "ident": when(any_mode, bit(60)),
        "atc": when(any_mode, bit(61)),
        "antenna": when(any_mode, bits(62, 1)),
        "sda": when(any_mode, bits(63, 2)),
        "gps_lateral_m": when(f"{any_mode} AND {surface}", f"({bits(65, 3)} & 3) * 2 * {when(bit(65), '1', '-1')}"),
        "gps_longitudinal_m": when(f"{any_mode} AND {surface}", f"{bits(68, 5)} * 2"),
        "length_m": when(ground, f"get({int_array_sql(LENGTH_METERS)}, {bits(53, 4)})"),
        "width_m": when(ground, f"get({int_array_sql(WIDTH_METERS).replace('<int>', '<double>')}, {bits(53, 4)})"),
        "nic_a": when(later, bit(86)),
        "nac_p": when(later, bits(77, 4)),
        "gva": when(air, bits(81, 2)),
        "sil": when(later, bits(83, 2)),
        "nic_baro": when(air, bits(85, 1)),
        "heading_type": when(ground, bits(85, 1)),
        "hrd": when(later, bits(86, 1)),
        "sil_supplement": when(f"{version} = 2", bits(87, 1)),
    }


def target_state():
    subtype = bits(38, 2)
    one, two = f"{subtype} = 0", f"{subtype} = 1"
    vertical, horizontal = bits(46, 2), bits(70, 2)
    source1, angle1 = bits(40, 2), bits(58, 2)
    altitude2, baro2 = bits(42, 11), bits(53, 9)
    modes = f"{two} AND {bit(79)}"
    return _type(29, 29), f"(({one} AND {vertical} <= 2 AND {horizontal} <= 2) OR {two})", {
        "subtype": subtype,
        "selected_altitude_ft": when(one, when(f"{source1} <> 0", f"{bits(48, 10)} * 100 - 1000"),
                                     when(f"{altitude2} <> 0", f"({altitude2} - 1) * 32")),
        "altitude_source": when(
            one, f"(CASE {source1} WHEN 1 THEN 'MCP/FCU' WHEN 2 THEN 'Holding Mode' WHEN 3 THEN 'FMS/RNAV' END)",
            when(bit(41), "'FMS'", "'MCP/FCU'")),
        "selected_heading": when(one, when(f"{angle1} <> 0", f"{bits(60, 9)} * 0.703125D"),
                                 when(bit(62), f"{bits(63, 9)} * 0.703125D")),
        "heading_type": when(f"{one} AND {angle1} <> 0", bits(69, 1)),
        "pressure_mb": when(f"{two} AND {baro2} <> 0", f"800.0D + ({baro2} - 1) * 0.8D"),
        "vertical_mode": when(one, vertical),
        "horizontal_mode": when(one, horizontal),
        "autopilot": when(modes, bit(80)),
        "vnav": when(modes, bit(81)),
        "altitude_hold": when(modes, bit(82)),
        "approach": when(modes, bit(84)),
        "lnav": when(two, bit(86)),
        "tcas": when(one, f"NOT {bit(84)}", bit(85)),
        "ra_active": when(one, bit(85)),
        "emergency": when(one, bits(86, 3)),
        "sil": bits(77, 2),
        "nac_p": bits(72, 4),
        "nic_baro": bits(76, 1),
    }


def no_position():
    return _type(0, 0), None, {"type_code": TYPE_CODE}


def project(df: DataFrame, kind) -> DataFrame:
    """Rows of one message kind with its fields as columns."""
    takes, decodes, fields = kind()
    keep = carried(df)
    rows = with_words(df).where(takes)
    if decodes is not None:
        rows = rows.where(decodes)
    return rows.selectExpr(*keep, *[f"{sql} AS `{name}`" for name, sql in fields.items()])


def decode_identification(df: DataFrame) -> DataFrame:
    """Callsign and emitter category."""
    return project(df, identification)


def decode_airborne_position(df: DataFrame) -> DataFrame:
    """Altitude and the raw position code of airborne reports."""
    return project(df, airborne_position)


def decode_surface_position(df: DataFrame) -> DataFrame:
    """Movement, ground track and the raw position code of surface reports."""
    return project(df, surface_position)


def decode_velocity(df: DataFrame) -> DataFrame:
    """Speed, direction, vertical rate and height difference, both velocity families."""
    return project(df, velocity)


def decode_velocity_ground(df: DataFrame) -> DataFrame:
    """Only the ground-speed family (subtypes 1 and 2)."""
    return decode_velocity(df).where("subtype IN (1, 2)")


def decode_velocity_air(df: DataFrame) -> DataFrame:
    """Only the air-speed family (subtypes 3 and 4)."""
    return decode_velocity(df).where("subtype IN (3, 4)")


def decode_status(df: DataFrame) -> DataFrame:
    """Emergency state and squawk of status reports."""
    return project(df, status)


def decode_operational_status(df: DataFrame) -> DataFrame:
    """Capabilities, modes, dimensions and quality figures."""
    return project(df, operational_status)


def decode_target_state(df: DataFrame) -> DataFrame:
    """Selected altitude, heading, pressure and autopilot modes."""
    return project(df, target_state)
