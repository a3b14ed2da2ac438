"""Decoders: whole tables of validated frames in, typed columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytally.operators.decode import extended, registers, surveillance
from skytally.operators.decode.extended import (
    decode_airborne_position,
    decode_identification,
    decode_operational_status,
    decode_status,
    decode_surface_position,
    decode_target_state,
    decode_velocity,
    decode_velocity_air,
    decode_velocity_ground,
)
from skytally.operators.decode.fields import (
    MOVEMENT_KNOTS,
    NO_ALTITUDE,
    WORDS,
    altitude_table,
    carried,
    register_bits,
    with_words,
)
from skytally.operators.decode.registers import (
    REGISTER_ORDER,
    REGISTERS,
    decode_df20_df21,
    decode_register,
    first_fit,
    infer_register,
    with_register_fits,
)
from skytally.operators.decode.surveillance import decode_df0, decode_df4, decode_df5, decode_df11, decode_df16
from skytally.operators.stages import compute_once

#: Message kinds in the order they are recognised, each with its decoder.
KINDS = {
    "identification": extended.identification,
    "airborne_position": extended.airborne_position,
    "surface_position": extended.surface_position,
    "velocity": extended.velocity,
    "status": extended.status,
    "operational_status": extended.operational_status,
    "target_state": extended.target_state,
    "no_position": extended.no_position,
    "air_air_short": surveillance.air_air_short,
    "air_air_long": surveillance.air_air_long,
    "altitude_reply": surveillance.altitude_reply,
    "identity_reply": surveillance.identity_reply,
    "all_call": surveillance.all_call,
    "comm_b": registers.comm_b,
}


def register_column(code: str) -> str:
    return "bds_" + code.replace(",", "")


def _kinds(rows: DataFrame) -> DataFrame:
    tests = []
    for name, kind in KINDS.items():
        takes, decodes, _ = kind()
        tests.append(f"WHEN {takes if decodes is None else f'{takes} AND {decodes}'} THEN '{name}'")
    return compute_once(rows, {
        "tc": f"(CASE WHEN {extended.EXTENDED} THEN {extended.TYPE_CODE} END)",
        "msg_type": f"(CASE {' '.join(tests)} END)",
    })


def classify(df: DataFrame) -> DataFrame:
    """Add ``tc`` (extended squitters only) and ``msg_type``; null kind means unsupported or rejected."""
    return _kinds(with_words(df)).drop(*WORDS)


def _struct(fields: dict[str, str]) -> str:
    return "struct(" + ", ".join(f"{sql} AS `{name}`" for name, sql in fields.items()) + ")"


def decode_messages(df: DataFrame, keep_unknown: bool = False, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """The wide message table: one nullable struct per kind and per register.

    Frames that do not decode are left out, or kept with a null kind if ``keep_unknown``. ``fields`` set: only the structs
    of its keys, with the fields it names; registers are looked for (and ``bds`` added) only if it asks for one.

    One narrow pass without a shuffle. Kind and register are settled first, each once;
    every struct is then guarded by a comparison with them.
    """
    keep = carried(df)
    rows = _kinds(with_words(df))
    if not keep_unknown:
        rows = rows.where("msg_type IS NOT NULL")
    decoded = {name: (f"msg_type = '{name}'", kind()[2]) for name, kind in KINDS.items()}
    inferred = fields is None or any(register_column(code) in fields for code in REGISTER_ORDER)
    if inferred:
        rows = compute_once(with_register_fits(rows), {"bds": first_fit()})
        decoded |= {register_column(code): (f"bds = '{code}'", REGISTERS[code]()[1]) for code in REGISTER_ORDER}
    if fields is not None:
        decoded = {name: (decoded[name][0], {f: decoded[name][1][f] for f in own}) for name, own in fields.items()}
    structs = {name: f"CASE WHEN {test} THEN {_struct(own)} END" for name, (test, own) in decoded.items() if own}
    if fields is not None:  # all are wanted; each gets a method of its own, as the JVM does not compile one of more than 8,000 bytes
        for name, sql in structs.items():
            rows = compute_once(rows, {name: f"({sql})"})
        structs = {name: name for name in structs}
    return rows.selectExpr(*keep, "tc", "msg_type", *(["bds"] if inferred else []), *[f"{sql} AS {name}" for name, sql in structs.items()])


def message_breakdown(df: DataFrame) -> DataFrame:
    """Counts and shares by downlink format, type code and register, most frequent first.

    One map-side combined count over (format, type code, register) feeds all three
    breakdowns; what follows works on a few hundred rows.
    """
    rows = with_register_fits(with_words(df.select("df", "frame")))
    keys = rows.selectExpr(
        "df", f"CASE WHEN {extended.EXTENDED} THEN {extended.TYPE_CODE} END AS tc", f"{first_fit()} AS bds")
    combined = keys.groupBy("df", "tc", "bds").agg(F.count(F.lit(1)).alias("n"))
    parts = combined.selectExpr(
        "inline(array(struct('df' AS breakdown, cast(df AS string) AS code), "
        "struct('tc' AS breakdown, cast(tc AS string) AS code), struct('bds' AS breakdown, bds AS code)))", "n").where("code IS NOT NULL")
    counts = parts.groupBy("breakdown", "code").agg(F.sum("n").alias("messages"))
    share = F.col("messages") * 100.0 / F.sum("messages").over(Window.partitionBy("breakdown"))
    return counts.withColumn("percent", share).orderBy("breakdown", F.col("messages").desc(), "code")


__all__ = [
    "KINDS",
    "MOVEMENT_KNOTS",
    "NO_ALTITUDE",
    "REGISTER_ORDER",
    "altitude_table",
    "classify",
    "decode_airborne_position",
    "decode_df0",
    "decode_df11",
    "decode_df16",
    "decode_df20_df21",
    "decode_df4",
    "decode_df5",
    "decode_identification",
    "decode_messages",
    "decode_operational_status",
    "decode_register",
    "decode_status",
    "decode_surface_position",
    "decode_target_state",
    "decode_velocity",
    "decode_velocity_air",
    "decode_velocity_ground",
    "infer_register",
    "message_breakdown",
    "register_bits",
    "register_column",
    "with_words",
]
