"""Frames back to the escaped wire layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.functions.bits import long_to_hex_sql


def wire_sql(frame: str = "frame", ts12: str = "ts12", signal: str = "signal") -> str:
    """Hex of one record: escape, kind, 6 tick bytes, signal byte, frame; escape bytes doubled."""
    level = f"rint(255.0D * sqrt({signal} / 255.0D))"
    body = f"concat({long_to_hex_sql(f'{ts12} & 281474976710655', 12)}, {long_to_hex_sql(level, 2)}, {frame})"
    pairs = f"regexp_replace({body}, '(..)', '$1 ')"
    return f"concat('1A', CASE length({frame}) WHEN 28 THEN '33' ELSE '32' END, replace(replace({pairs}, '1A ', '1A1A'), ' ', ''))"


def to_wire(df: DataFrame, frame: str = "frame", ts12: str = "ts12", signal: str = "signal") -> DataFrame:
    """Add ``wire``, the bytes of every frame as a receiver would send them."""
    return df.withColumn("wire", F.unhex(F.expr(wire_sql(frame, ts12, signal))))
