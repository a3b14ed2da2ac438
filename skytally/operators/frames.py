"""Frame checks: header, CRC, validation, de-duplication and the confidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.functions.bits import bit_field_sql, hex_to_long_sql, int_array_sql, long_to_hex_sql
from skytally.operators.folds import interval_micros
from skytally.operators.ordered import Highest, Previous, Total, as_list, micros, scan, split_hot_keys
from skytally.operators.stages import compute_once

# CRC-24 generator (with its top bit) and the formats that carry their address in clear.
CRC_GENERATOR = 0x1FFF409
PI_FORMATS = (11, 17, 18, 19)
#: Detections needed by confidence level.
CONFIDENCE_LEVELS = {"low": 5, "medium": 10, "high": 15}


def bit_syndromes(n_bits: int) -> list[int]:
    """Remainder left by each single bit of an ``n_bits`` frame, first bit first."""
    out, power = [], 1
    for _ in range(n_bits):
        out.append(power)
        power <<= 1
        if power >> 24:
            power ^= CRC_GENERATOR
    return out[::-1]


def _words(frame: str) -> dict[str, str]:
    """The frame as two 56-bit words, short frames padded with leading zeros.

    Leading zeros leave a CRC remainder unchanged, so both lengths share one formula.
    """
    padded = f"lpad(`{frame}`, 28, '0')"
    return {"_head": hex_to_long_sql(f"substring({padded}, 1, 14)"),
            "_tail": hex_to_long_sql(f"substring({padded}, 15, 14)")}


def _byte_remainders(position: int) -> list[int]:
    """Remainder of each byte value at one of the 14 byte positions."""
    bits = bit_syndromes(112)[8 * position:8 * position + 8]
    table = []
    for value in range(256):
        remainder = 0
        for k, syndrome in enumerate(bits):
            if value >> (7 - k) & 1:
                remainder ^= syndrome
        table.append(remainder)
    return table


def crc_sql(head: str = "_head", tail: str = "_tail") -> str:
    """CRC remainder of a whole frame: division is linear over XOR, so one lookup per byte."""
    parts = []
    for position in range(14):
        word, place = (head, position) if position < 7 else (tail, position - 7)
        parts.append(f"get({int_array_sql(_byte_remainders(position))}, {bit_field_sql(word, 56, 8 * place + 1, 8)})")
    return "(" + " ^ ".join(parts) + ")"


_PI_SQL = f"df IN {PI_FORMATS}"


def with_frame_header(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Downlink format, length and whether the address is sent in clear."""
    first = hex_to_long_sql(f"substring(`{frame}`, 1, 2)")
    header = df.selectExpr("*", f"cast(shiftright({first}, 3) as int) AS df",
                           f"cast(length(`{frame}`) / 2 as int) AS n_bytes",
                           f"length(`{frame}`) * 4 AS n_bits")
    return header.withColumn("pi_mode", F.expr(_PI_SQL))


def with_crc(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Add ``crc``, the 24-bit remainder over the whole frame."""
    words = compute_once(df, _words(frame))
    return words.withColumn("crc", F.expr(crc_sql())).drop("_head", "_tail")


def _frame_checks(df: DataFrame, frame: str, correct: bool) -> DataFrame:
    """Header, remainder, wrong bit (1-based in the padded frame, 0 for none) and status per frame."""
    words = compute_once(df.where(f"length(`{frame}`) IN (14, 28)"), _words(frame))
    out = compute_once(words, {
        "df": f"cast(shiftrightunsigned(CASE WHEN length(`{frame}`) = 28 THEN _head ELSE _tail END, 51) as int)",
        "n_bits": f"length(`{frame}`) * 4",
        "crc": crc_sql(),
    })
    faulty = f"({_PI_SQL} AND crc <> 0)"
    bit = "0"
    if correct:
        # 112 constants; only a faulty frame is looked up. A short frame occupies the last 56 positions.
        found = f"cast(array_position({int_array_sql(bit_syndromes(112))}, crc) as int)"
        bit = f"CASE WHEN {faulty} AND (n_bits = 112 OR {found} > 56) THEN {found} ELSE 0 END"
    out = compute_once(out, {"flipped_bit": bit})
    return out.selectExpr("*", f"{_PI_SQL} AS pi_mode", f"""
        CASE WHEN NOT {faulty} THEN 'valid' WHEN flipped_bit > 0 THEN 'corrected' ELSE 'invalid' END AS status""")


def _flipped(word: str, first: int) -> str:
    """A word with the wrong bit inverted if it lies in the 56 positions from ``first``."""
    last = first + 55
    return (f"CASE WHEN flipped_bit BETWEEN {first} AND {last} "
            f"THEN {word} ^ shiftleft(1L, {last} - flipped_bit) ELSE {word} END")


def _repaired(df: DataFrame, frame: str) -> DataFrame:
    """Wrong bits inverted, address added, working columns dropped."""
    words = compute_once(df, {"_head": _flipped("_head", 1), "_tail": _flipped("_tail", 57)})
    tail = long_to_hex_sql("_tail", 14)
    text = f"CASE WHEN n_bits = 112 THEN concat({long_to_hex_sql('_head', 14)}, {tail}) ELSE {tail} END"
    clear = bit_field_sql("(CASE WHEN n_bits = 112 THEN _head ELSE _tail END)", 56, 9, 24)
    out = compute_once(words, {
        frame: f"CASE WHEN flipped_bit > 0 THEN {text} ELSE `{frame}` END",
        "icao_raw": f"CASE WHEN pi_mode THEN {clear} ELSE crc END",
    })
    return out.selectExpr(
        "*", "cast(n_bits / 8 as int) AS n_bytes", f"{long_to_hex_sql('icao_raw', 6)} AS icao",
        "flipped_bit > 0 AS was_corrected",
    ).drop("_head", "_tail", "status", "flipped_bit")


def correct_single_bit(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Frames with a clear address whose remainder names one wrong bit, with that bit flipped."""
    return _repaired(_frame_checks(df, frame, True).where("status = 'corrected'"), frame)


def validate_frames(df: DataFrame, frame: str = "frame", correct: bool = True) -> DataFrame:
    """Keep valid frames, repair one-bit errors, add the aircraft address.

    Formats with a clear address must leave remainder 0 (or a one-bit syndrome); for the
    others the remainder is the address and every frame passes.
    """
    return _repaired(_frame_checks(df, frame, correct).where("status <> 'invalid'"), frame)


def dedup_within(df: DataFrame, keys, ts: str, window="50 milliseconds", order=None, only: Column | None = None) -> DataFrame:
    """Drop a row whose previous row with equal keys is at most ``window`` older.

    The previous row counts whether or not it was dropped itself, so a chain of near
    repeats keeps only its first row. Rows for which ``only`` does not hold are all kept.
    """
    limit = interval_micros(df.sparkSession, window)
    seen = scan(df, keys, order or [ts], _before=Previous(micros(ts)))
    first = F.col("_before").isNull() | (micros(ts) - F.col("_before") > limit)
    return seen.where(first if only is None else first | ~F.coalesce(only, F.lit(False))).drop("_before")


def with_detections(df: DataFrame, key, ts: str, timeout="30 seconds", order=None,
                    weight: Column | None = None) -> DataFrame:
    """Add ``detections``: how often the key was seen since its last silence over ``timeout``."""
    order = order or [ts]
    limit = interval_micros(df.sparkSession, timeout)
    keys = as_list(key)
    step = F.lit(1).cast("long") if weight is None else weight.cast("long")
    seen = scan(df, keys, order, _before=Previous(micros(ts)))
    seen = seen.withColumns({
        "_restart": F.col("_before").isNull() | (micros(ts) - F.col("_before") > limit),
        "_weight": step,
    })
    seen = scan(seen, keys, order, _sum=Total(F.col("_weight")))
    # The count before a restart only grows, so the newest one is the largest.
    seen = scan(seen, keys, order, _base=Highest(F.when(F.col("_restart"), F.col("_sum") - F.col("_weight"))))
    return seen.withColumn("detections", F.col("_sum") - F.col("_base")).drop(
        "_before", "_restart", "_weight", "_sum", "_base")


def confidence_gate(df: DataFrame, key, ts: str, n: int = 10, timeout="30 seconds", order=None,
                    trusted: Column | None = None) -> DataFrame:
    """Keep rows from the n-th detection of a key on; the count restarts after silence.

    ``trusted`` (a boolean column) marks sightings that make the key confident at once.
    """
    weight = None if trusted is None else F.when(F.coalesce(trusted, F.lit(False)), F.lit(n)).otherwise(F.lit(1))
    return with_detections(df, key, ts, timeout, order, weight).where(F.col("detections") >= n)


def trusted_gate(df: DataFrame, trusted: DataFrame, key, ts: str, n: int = 10, timeout="30 seconds",
                 order=None) -> DataFrame:
    """``confidence_gate`` with the trusted sightings in a table of their own (key and ts).

    Only rows of ``df`` come out; a trusted sighting lifts the key from its time on.
    """
    keys = as_list(key)
    order = order or [ts]
    rows = df.withColumn("_trusted", F.lit(False))
    marks = trusted.withColumn("_trusted", F.lit(True))
    both = rows.unionByName(marks, allowMissingColumns=True)
    gated = confidence_gate(both, keys, ts, n, timeout, order, F.col("_trusted"))
    return gated.where(~F.col("_trusted")).drop("_trusted")


def confirmed_keys(df: DataFrame, key, ts: str, n: int = 10, timeout="30 seconds", order=None,
                   pi_mode: str | None = None) -> DataFrame:
    """Per key: detections, first time confirmed, whether still confirmed, clear / overlaid counts."""
    keys = as_list(key)
    seen = with_detections(df, keys, ts, timeout, order)
    clear = F.col(pi_mode) if pi_mode else F.lit(False)
    last = F.struct(*[F.col(c) for c in (order or [ts])])
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("detections") >= n).alias("confident"),
        F.min(F.when(F.col("detections") >= n, F.col(ts))).alias("confirmed_at"),
        (F.max_by("detections", last) >= n).alias("is_confirmed"),
        F.count_if(clear).alias("clear_count"),
        F.count_if(~clear).alias("overlay_count"),
    )


def validation_stats(df: DataFrame, ts: str = "ts", frame: str = "frame", window="50 milliseconds", n: int = 10,
                     timeout="30 seconds", order=None, rows_per_slice: int | None = None) -> DataFrame:
    """One row: checked, valid, corrected, invalid, duplicate and unconfident counts and rates.

    ``rows_per_slice`` set: addresses of more rows are cut into slices first.
    """
    order = order or [ts]
    limit = interval_micros(df.sparkSession, window)
    checked = _frame_checks(df, frame, True)
    good = validate_frames(df, frame)
    if rows_per_slice is not None:
        good = split_hot_keys(good, [["icao_raw"]], order, rows_per_slice, rows=df.count())
    seen = with_detections(good, "icao_raw", ts, timeout, order)
    seen = scan(seen, ["icao_raw", frame], order, _before=Previous(F.when(F.col("detections") >= n, micros(ts))))
    counts = checked.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("status") == "valid").alias("valid"),
        F.count_if(F.col("status") == "corrected").alias("corrected"),
        F.count_if(F.col("status") == "invalid").alias("invalid"),
    )
    later = seen.agg(
        F.count_if(F.col("detections") < n).alias("unconfident"),
        F.count_if((F.col("detections") >= n) & (micros(ts) - F.col("_before") <= limit)).alias("duplicate"),
    )
    out = counts.crossJoin(later)  # one row by one row

    def rate(a, b):
        return F.when(F.col(b) > 0, F.round(F.col(a) * 100.0 / F.col(b), 1)).otherwise(F.lit(0.0))

    return out.withColumns({
        "valid_rate": rate("valid", "checked"),
        "corrected_rate": rate("corrected", "checked"),
        "invalid_rate": rate("invalid", "checked"),
    })


