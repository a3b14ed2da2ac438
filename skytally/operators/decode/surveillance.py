"""Surveillance, all-call and air-to-air replies."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.bits import long_to_hex_sql
from skytally.operators.decode.extended import project
from skytally.operators.decode.fields import VALID_REPLY_INFORMATION, bit, bits, squawk, when

_REPLY_KNOWN = f"{bits(14, 4)} IN {VALID_REPLY_INFORMATION}"


def air_air_short():
    return "df = 0", _REPLY_KNOWN, {
        "on_ground": bit(6),
        "cross_link": bit(7),
        "sensitivity": bits(9, 3),
        "reply_information": bits(14, 4),
        "altitude_ft": "_alt",
    }


def air_air_long():
    advisory = f"{bits(33, 8)} = 48"
    return "df = 16", _REPLY_KNOWN, {
        "on_ground": bit(6),
        "sensitivity": bits(9, 3),
        "reply_information": bits(14, 4),
        "altitude_ft": "_alt",
        "acas_valid": f"({advisory})",
        "not_below": when(advisory, bit(55)),
        "not_above": when(advisory, bit(56)),
        "not_left": when(advisory, bit(57)),
        "not_right": when(advisory, bit(58)),
        "ra_terminated": when(advisory, bit(59)),
        "multiple_threat": when(advisory, bit(60)),
    }


def altitude_reply():
    return "df = 4", None, {"flight_status": bits(6, 3), "altitude_ft": "_alt"}


def identity_reply():
    return "df = 5", None, {"flight_status": bits(6, 3), "squawk": squawk("_code")}


def all_call():
    return "df = 11", None, {"capability": bits(6, 3), "announced_icao": long_to_hex_sql(bits(9, 24), 6)}


def decode_df0(df: DataFrame) -> DataFrame:
    """Short air-to-air replies; a reserved reply code rejects the row."""
    return project(df, air_air_short)


def decode_df16(df: DataFrame) -> DataFrame:
    """Long air-to-air replies with the resolution advisory if one is carried."""
    return project(df, air_air_long)


def decode_df4(df: DataFrame) -> DataFrame:
    """Altitude replies."""
    return project(df, altitude_reply)


def decode_df5(df: DataFrame) -> DataFrame:
    """Identity replies."""
    return project(df, identity_reply)


def decode_df11(df: DataFrame) -> DataFrame:
    """All-call replies."""
    return project(df, all_call)
