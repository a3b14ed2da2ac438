"""Shared field readers of the decoders, as SQL text.

``_head`` holds frame bits 1-56 (the first seven bytes), ``_me`` bits 33-88 (the payload of
a long frame). Both are computed once per row by ``with_words``.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame

from skytally.functions.bits import bit_field_sql, bit_flag_sql, hex_to_long_sql, int_array_sql
from skytally.functions.units import METERS_PER_FOOT
from skytally.operators.stages import compute_once, quoted

# Aircraft categories in use, surface movement codes with their speed in
# knots, reply information codes in use, aircraft length and width in metres by code.
VALID_CATEGORIES = (0, 10, 21, 23, 31, 32, 33, 40, 41, 42, 43, 44, 45, 46, 47)
MOVEMENT_KNOTS = {
    1: 0, 2: 0, 3: 0, 4: 1, 5: 3, 6: 7, 7: 12, 8: 17, 9: 25, 10: 35, 11: 45, 12: 55, 13: 65, 14: 75, 15: 85,
    16: 95, 17: 105, 18: 115, 19: 125, 20: 135, 21: 145, 22: 155, 23: 167, 24: 187, 124: 199,
}
VALID_REPLY_INFORMATION = (0, 2, 3, 4, 8, 9, 10, 11, 12, 13, 14)
LENGTH_METERS = (0, 15, 25, 25, 35, 35, 45, 45, 55, 55, 65, 65, 75, 75, 85, 85)
WIDTH_METERS = (0.0, 23.0, 28.5, 34.0, 33.0, 38.0, 39.5, 45.0, 45.0, 52.0, 59.5, 67.0, 72.5, 80.0, 80.0, 90.0)


WORDS = ("_head", "_me", "_tc", "_sub", "_code", "_alt")


def with_words(df: DataFrame, frame: str = "frame") -> DataFrame:
    """The working columns of the decoders.

    ``_tc`` and ``_sub`` are the type code and the three bits after it, ``_alt`` the feet of
    the altitude field the format carries: 13 bits of a reply or 12 bits of a position
    report, which is the same code without its M bit.
    """
    if "_me" in df.columns:
        return df
    words = compute_once(df, {
        "_head": hex_to_long_sql(f"substring(`{frame}`, 1, 14)"),
        "_me": hex_to_long_sql(f"substring(rpad(`{frame}`, 28, '0'), 9, 14)"),
    })
    report = bits(41, 12)
    words = compute_once(words, {
        "_tc": bits(33, 5),
        "_sub": bits(38, 3),
        "_code": f"(CASE WHEN df >= 17 AND df <= 19 THEN shiftleft({report} & 4032, 1) | ({report} & 63) ELSE {bits(20, 13)} END)",
    })
    return words.selectExpr("*", f"nullif(get({int_array_sql(altitude_table())}, _code), {NO_ALTITUDE}) AS _alt")


def carried(df: DataFrame) -> list[str]:
    """Columns a decoder passes on: all but the working words."""
    return quoted(c for c in df.columns if c not in WORDS)


def bits(start: int, count: int) -> str:
    """``count`` bits from 1-based frame position ``start``."""
    if start < 33:
        return bit_field_sql("_head", 56, start, count)
    return bit_field_sql("_me", 56, start - 32, count)


def bit(position: int) -> str:
    if position < 33:
        return bit_flag_sql("_head", 56, position)
    return bit_flag_sql("_me", 56, position - 32)


def register_bits(start: int, count: int) -> str:
    """``count`` bits from 1-based position ``start`` of the 56-bit register."""
    return bit_field_sql("_me", 56, start, count)


def register_bit(position: int) -> str:
    return bit_flag_sql("_me", 56, position)


def register_zero(*ranges: tuple[int, int]) -> str:
    """All bits of the given (start, count) ranges are zero, as one mask test."""
    return f"(_me & {range_mask(*ranges)}L) = 0L"


def register_set(*positions: int) -> str:
    """All given bits are set, as one mask test."""
    mask = range_mask(*[(p, 1) for p in positions])
    return f"(_me & {mask}L) = {mask}L"


def range_mask(*ranges: tuple[int, int]) -> int:
    return sum(((1 << count) - 1) << (57 - start - count) for start, count in ranges)


def when(condition: str, value: str, otherwise: str | None = None) -> str:
    tail = "" if otherwise is None else f" ELSE {otherwise}"
    return f"(CASE WHEN {condition} THEN {value}{tail} END)"


def text6(start: int, count: int = 8) -> str:
    """Six-bit characters: codes 0-31 are ASCII 64-95, codes 32-63 stand for themselves."""
    codes = [bits(start + 6 * i, 6) for i in range(count)]
    return "concat(" + ", ".join(f"chr({c} + {when(f'{c} < 32', '64', '0')})" for c in codes) + ")"


def pick(value: str, *positions: int) -> str:
    """Integer made of the given bits (0 = lowest) of ``value``, highest first."""
    parts = []
    for target, source in enumerate(reversed(positions)):
        moved = value if source == target else (
            f"shiftright({value}, {source - target})" if source > target else f"shiftleft({value}, {target - source})")
        parts.append(f"({moved} & {1 << target})")
    return "(" + " | ".join(parts) + ")"


def _binary_of_gray(code: int, positions: tuple[int, ...]) -> int:
    """Gray code to binary: each bit is the parity of the code bits from the highest down to it."""
    value, parity = 0, 0
    for p in positions:
        parity ^= code >> p & 1
        value = value << 1 | parity
    return value


def gray_altitude(code: int) -> int | None:
    """Hundreds of feet of a 13-bit Gillham code with clear M and Q bits, None if invalid.

    Bit order of the code, highest first: C1 A1 C2 A2 C4 A4 M B1 Q B2 D2 B4 D4.
    """
    hundreds = _binary_of_gray(code, (12, 10, 8))
    hundreds = {7: 5, 5: 7}.get(hundreds, hundreds)
    if not 1 <= hundreds <= 5:
        return None
    fives = _binary_of_gray(code, (2, 0, 11, 9, 7, 5, 3, 1))
    return fives * 5 + (6 - hundreds if fives & 1 else hundreds) - 13


NO_ALTITUDE = -99999


def altitude13(code: int) -> int | None:
    """Feet of a 13-bit altitude code, None if unknown or invalid.

    A metric code (M bit) is read as its low 12 bits with the M bit still in place.
    """
    if code == 0:
        return None
    if code & 64:
        return round((code & 4095) / METERS_PER_FOOT)
    if code & 16:
        steps = 0
        for p in (12, 11, 10, 9, 8, 7, 5, 3, 2, 1, 0):
            steps = steps << 1 | code >> p & 1
        return steps * 25 - 1000
    hundreds = gray_altitude(code)
    return None if hundreds is None else hundreds * 100


@cache
def altitude_table() -> tuple[int, ...]:
    """Feet of all 8192 codes, made from the rule; the decoders look the code up."""
    feet = (altitude13(code) for code in range(8192))
    return tuple(NO_ALTITUDE if f is None else f for f in feet)


def feet_of_meters(meters: str) -> str:
    return f"cast(rint({meters} / {METERS_PER_FOOT}D) as int)"


def squawk(code: str) -> str:
    """Four octal digits of a 13-bit identity field."""
    digits = [(7, 9, 11), (1, 3, 5), (8, 10, 12), (0, 2, 4)]
    return "concat(" + ", ".join(pick(code, *d) for d in digits) + ")"
