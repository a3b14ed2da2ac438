"""Comm-B replies: which register a 56-bit payload is, and its fields, as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.bits import signed_sql
from skytally.operators.decode.fields import bits, carried, register_set, register_zero, squawk, text6, when, with_words
from skytally.operators.decode.fields import register_bit as bit
from skytally.operators.decode.fields import register_bits as field
from skytally.operators.stages import compute_once

#: Order in which registers are tried; the first whose guard holds is taken.
REGISTER_ORDER = ("1,0", "2,0", "3,0", "1,7", "4,0", "5,0", "6,0", "4,4", "4,5", "5,3")
COMM_B = "df IN (20, 21)"


def _all(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def _code(value: int) -> str:
    return f"{field(1, 8)} = {value}"


def register_10():
    overlay, dti = bit(15), field(17, 7)
    guard = _all(_code(0x10), register_zero((10, 5)), when(overlay, f"{dti} >= 5", f"{dti} <= 4"))
    return guard, {"capability_bits": field(9, 16)}


def register_17():
    return _all(register_zero((25, 32)), bit(7)), {"register_mask": f"cast({field(1, 24)} as bigint)"}


def register_20():
    # The eight characters start at register bit 9, frame bit 41.
    text, empty = f"trim({text6(41)})", register_zero((9, 48))
    named = f"({empty} OR NOT contains({text}, '#') OR {text} = '########')"
    return _all(_code(0x20), named), {"callsign": when(empty, "''", text)}


def register_30():
    return _all(_code(0x30), f"{field(29, 2)} <> 3", f"{field(16, 7)} < 48"), {}


def register_40():
    mcp, fms, baro, modes, source = (bit(1), field(2, 12)), (bit(14), field(15, 12)), (bit(27), field(28, 12)), 48, 54
    has_mcp, has_fms, has_baro = (f"({flag} AND {raw} <> 0)" for flag, raw in (mcp, fms, baro))
    pressure = f"(800.0D + {baro[1]} * 0.1D)"
    guard = _all(
        register_zero((40, 8), (52, 2)),
        f"({has_mcp} OR {has_fms} OR {has_baro} OR {bit(modes)} OR {bit(source)})",
        f"(NOT {has_baro} OR {pressure} <= 1200.0D)",
    )
    return guard, {
        "mcp_altitude_ft": when(has_mcp, f"{mcp[1]} * 16"),
        "fms_altitude_ft": when(has_fms, f"{fms[1]} * 16"),
        "pressure_mb": when(has_baro, pressure),
        "nav_modes": when(bit(modes), field(49, 3)),
        "altitude_source": when(bit(source), field(55, 2)),
    }


def register_44():
    wind, pressure, turbulence, humidity = bit(5), bit(35), bit(47), bit(50)
    temperature = f"(({field(25, 10)} - {when(bit(24), '1024', '0')}) * 0.25D)"
    # Each value without its status bit must be zero.
    guard = _all(
        f"{field(1, 4)} <= 4",
        when(wind, f"{field(6, 9)} <= 250", register_zero((6, 18))),
        f"{temperature} BETWEEN -80.0D AND 60.0D",
        f"({pressure} OR {register_zero((36, 11))})",
        f"({turbulence} OR {register_zero((48, 2))})",
        f"({humidity} OR {register_zero((51, 6))})",
    )
    return guard, {
        "figure_of_merit": field(1, 4),
        "wind_speed_kt": when(wind, field(6, 9)),
        "wind_direction": when(wind, f"{field(15, 9)} * 0.703125D"),
        "temperature": temperature,
        "pressure": when(pressure, f"cast({field(36, 11)} as double)"),
        "turbulence": when(turbulence, field(48, 2)),
        "humidity": when(humidity, f"{field(51, 6)} * 1.5625D"),
    }


def register_45():
    def level(position):
        return when(bit(position), field(position + 1, 2))

    temperature = f"({signed_sql(field(17, 10), 10)} * 0.25D)"
    pressure, height = field(28, 11), f"({field(40, 12)} * 16)"
    no_status = register_zero(*[(p, 1) for p in (1, 4, 7, 10, 13, 16, 27, 39)])
    guard = _all(
        register_zero((52, 5)), f"NOT ({no_status})",
        f"(NOT {bit(16)} OR {temperature} BETWEEN -80.0D AND 60.0D)",
        f"(NOT {bit(27)} OR {pressure} BETWEEN 100 AND 1200)",
        f"(NOT {bit(39)} OR {height} <= 5000)",
    )
    return guard, {
        "turbulence": level(1), "wind_shear": level(4), "microburst": level(7), "icing": level(10),
        "wake_vortex": level(13), "temperature": when(bit(16), temperature),
        "pressure": when(bit(27), f"cast({pressure} as double)"), "radio_height_ft": when(bit(39), height),
    }


def register_50():
    roll = f"({signed_sql(field(2, 10), 10)} * 0.17578125D)"
    track = f"({signed_sql(field(13, 11), 11)} * 0.17578125D)"
    rate = f"({signed_sql(field(36, 10), 10)} * 0.03125D)"
    ground, air = f"({field(25, 10)} * 2)", f"({field(47, 10)} * 2)"
    guard = _all(register_set(1, 12, 24, 46), f"abs({roll}) <= 50.0D", f"abs({ground} - {air}) <= 200",
                 f"(NOT {bit(35)} OR abs({rate}) <= 10.0D)")
    return guard, {"roll": roll, "track_angle": when(f"{track} < 0", f"{track} + 360.0D", track),
                   "ground_speed_kt": ground, "true_airspeed_kt": air, "track_rate": when(bit(35), rate)}


def register_60():
    baro, inertial = (f"({signed_sql(field(p, 10), 10)} * 32)" for p in (36, 47))
    mach = f"({field(25, 10)} * 0.004D)"
    # The heading field has 11 bits, so it cannot leave 0..360.
    guard = _all(register_set(1, 13, 24), f"({bit(35)} OR {bit(46)})", f"{field(14, 10)} <= 500", f"{mach} <= 1.0D",
                 f"(NOT {bit(35)} OR abs({baro}) <= 6000)", f"(NOT {bit(46)} OR abs({inertial}) <= 6000)")
    return guard, {"magnetic_heading": f"{field(2, 11)} * 0.17578125D", "indicated_airspeed_kt": field(14, 10),
                   "mach": mach, "baro_rate": when(bit(35), baro), "inertial_rate": when(bit(46), inertial)}


def register_53():
    ias, mach, tas = field(14, 10), f"({field(25, 9)} * 0.008D)", f"cast(floor({field(35, 12)} * 0.5D) as int)"
    raw = field(49, 8)
    rate = f"(CASE WHEN {raw} IN (0, 255) THEN 0 ELSE {raw} * 64 * {when(bit(48), '-1', '1')} END)"
    guard = _all(
        f"NOT ({register_zero((1, 1), (13, 1), (24, 1), (34, 1), (47, 1))})",
        f"(NOT {bit(13)} OR {ias} <= 500)", f"(NOT {bit(24)} OR {mach} <= 1.0D)",
        f"(NOT {bit(34)} OR {tas} <= 500)", f"(NOT {bit(47)} OR abs({rate}) <= 8000)",
    )
    return guard, {
        "magnetic_heading": when(bit(1), f"{field(2, 11)} * 0.17578125D"),
        "indicated_airspeed_kt": when(bit(13), ias),
        "mach": when(bit(24), mach),
        "true_airspeed_kt": when(bit(34), tas),
        "vertical_rate": when(bit(47), rate),
    }


REGISTERS = {
    "1,0": register_10, "1,7": register_17, "2,0": register_20, "3,0": register_30, "4,0": register_40,
    "4,4": register_44, "4,5": register_45, "5,0": register_50, "5,3": register_53, "6,0": register_60,
}


def comm_b():
    """Envelope of DF 20 and DF 21."""
    return COMM_B, None, {
        "flight_status": bits(6, 3),
        "downlink_request": bits(9, 5),
        "utility_message": bits(14, 6),
        "altitude_ft": when("df = 20", "_alt"),
        "squawk": when("df = 21", squawk("_code")),
    }


def fit_column(code: str) -> str:
    return "_fits_" + code.replace(",", "")


def with_register_fits(rows: DataFrame) -> DataFrame:
    """One boolean per register whose guard holds; tried for DF 20 and 21 only."""
    return compute_once(rows, {fit_column(c): f"{COMM_B} AND ({REGISTERS[c]()[0]})" for c in REGISTER_ORDER})


def first_fit() -> str:
    """Register by order of trial; null for rows that carry none."""
    tries = " ".join(f"WHEN {fit_column(code)} THEN '{code}'" for code in REGISTER_ORDER)
    return f"(CASE WHEN NOT {COMM_B} THEN null WHEN _me = 0 THEN 'Empty' {tries} ELSE 'Unknown' END)"


def infer_register(df: DataFrame) -> DataFrame:
    """Add ``bds``, the register of a DF 20 / 21 payload, and ``bds_candidates``, all whose guard holds.

    Several registers can fit one payload; the order of trial decides. ``Empty`` is an
    all-zero payload, ``Unknown`` one that fits nothing.
    """
    rows = with_register_fits(with_words(df).where(COMM_B))
    fits = ", ".join(when(f"{fit_column(code)} AND _me <> 0", f"'{code}'") for code in REGISTER_ORDER)
    out = compute_once(rows, {"bds": first_fit(), "bds_candidates": f"concat_ws(' ', {fits})"})
    return out.drop(*[fit_column(code) for code in REGISTER_ORDER])


def decode_df20_df21(df: DataFrame) -> DataFrame:
    """Comm-B envelope with the inferred register."""
    envelope = [f"{sql} AS `{name}`" for name, sql in comm_b()[2].items()]
    return infer_register(df).selectExpr(*carried(df), *envelope, "bds", "bds_candidates")


def decode_register(df: DataFrame, code: str) -> DataFrame:
    """Rows inferred to be one register, with its fields as columns."""
    rows = infer_register(df).where(f"bds = '{code}'")
    return rows.selectExpr(*carried(df), *[f"{sql} AS `{name}`" for name, sql in REGISTERS[code]()[1].items()])
