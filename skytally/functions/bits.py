"""Bit fields of hexadecimal frames, as JVM expressions.

A frame is 14 or 28 upper-case hex characters. Seven bytes at a time fit a signed long, so
every field read is one shift and one mask on a primitive column. The decoders combine
hundreds of these; they are written as SQL text, which Spark parses in one call each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_long_sql(text: str) -> str:
    # Never null, which keeps the generated code of everything built on it short.
    return f"coalesce(cast(conv({text}, 16, 10) as bigint), 0L)"


def long_to_hex_sql(value: str, digits: int) -> str:
    return f"lpad(hex(cast({value} as bigint)), {digits}, '0')"


def bit_field_sql(word: str, width: int, start: int, count: int) -> str:
    """``count`` bits from 1-based position ``start`` of a ``width``-bit word."""
    shift = width - start - count + 1
    shifted = f"shiftrightunsigned({word}, {shift})" if shift else word
    field = f"({shifted} & {(1 << count) - 1})"
    return f"cast({field} as int)" if count < 31 else field


def bit_flag_sql(word: str, width: int, position: int) -> str:
    """Whether a bit is set, as one mask test."""
    return f"(({word} & {1 << (width - position)}L) <> 0L)"


def signed_sql(field: str, count: int) -> str:
    """Two's complement reading of a ``count``-bit field."""
    return f"(CASE WHEN {field} >= {1 << (count - 1)} THEN {field} - {1 << count} ELSE {field} END)"


def int_array_sql(values) -> str:
    """Constant array of integers, folded to one literal when the query is planned."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<int>)"


def hex_to_long(text: Column) -> Column:
    """Value of up to 15 hex digits as a long."""
    return F.conv(text, 16, 10).cast("long")


def long_to_hex(value: Column, digits: int) -> Column:
    """Upper-case hex of a non-negative long, zero-padded to ``digits``."""
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def hex_mask(value: Column, digits: int) -> Column:
    """``0x`` string of fixed width; null stays null."""
    return F.concat(F.lit("0x"), long_to_hex(value, digits))


def bit_field(word: str, width: int, start: int, count: int) -> Column:
    """Column form of ``bit_field_sql`` for a named word column."""
    return F.expr(bit_field_sql(word, width, start, count))
