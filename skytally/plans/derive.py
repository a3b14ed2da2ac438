"""Frames and registry rows derived from general event and customer tables.

Every event becomes one frame: its user is the aircraft, its type chooses the message
family, the hash of its id fills the payload, and time runs 3600 times faster, so that hours
between events become seconds between frames. Aircraft fly straight lines; some positions
jump, some frames carry a wrong bit or are noise. All of it is integer arithmetic in one
projection, so the table grows with the events and costs no shuffle.

The text is written for two dialects, since the check queries build the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.operators.frames import bit_syndromes, crc_sql
from skytally.operators.positions import ZONE_LATITUDES
from skytally.operators.stages import compute_once

ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01
TIME_SCALE = 3600
RECEIVER = (46.907982, 19.693172)

#: Register templates: bits kept from the hash and bits set, as (keep, set) of a 56-bit payload.


def _mask(*ranges) -> int:
    """56-bit mask with the given 1-based bit ranges set."""
    value = 0
    for start, count in ranges:
        value |= ((1 << count) - 1) << (56 - start - count + 1)
    return value


FULL = (1 << 56) - 1
REGISTER_TEMPLATES = {
    # keep mask, set mask
    0: (FULL & ~_mask((40, 8), (52, 2)), _mask((1, 1), (14, 1), (27, 1))),
    1: (FULL & ~_mask((2, 1), (25, 4), (36, 2), (47, 4)), _mask((1, 1), (12, 1), (24, 1), (25, 1), (46, 1), (47, 1))),
    2: (FULL & ~_mask((14, 2), (25, 2), (37, 3), (48, 3)), _mask((1, 1), (13, 1), (24, 1), (35, 1), (46, 1))),
    3: (_mask((8, 7), (15, 9), (28, 7), (37, 10), (48, 2), (51, 6)),
        _mask((4, 1), (5, 1), (24, 1), (25, 2), (35, 1), (47, 1), (50, 1))),
    4: (FULL & ~_mask((17, 2), (28, 2), (40, 4), (52, 5)), _mask((1, 1), (29, 1))),
    5: (FULL & ~_mask((14, 2), (25, 2), (35, 2), (49, 2)), _mask((1, 1), (52, 5))),
}


class Dialect:
    def __init__(self, name: str):
        self.spark = name == "spark"

    def div(self, a, b):
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def xor(self, a, b):
        return f"(({a}) ^ ({b}))" if self.spark else f"xor({a}, {b})"

    def shl(self, a, n):
        return f"shiftleft(cast({a} as bigint), {n})" if self.spark else f"(cast({a} as bigint) << {n})"

    def shr(self, a, n):
        return f"shiftright({a}, {n})" if self.spark else f"(({a}) >> {n})"

    def long(self, hex_text):
        return f"coalesce(cast(conv({hex_text}, 16, 10) as bigint), 0L)" if self.spark else f"cast('0x' || {hex_text} as bigint)"

    def hex(self, value, digits):
        return (f"lpad(hex(cast({value} as bigint)), {digits}, '0')" if self.spark
                else f"upper(lpad(to_hex(cast({value} as bigint)), {digits}, '0'))")

    def micros(self, ts):
        return f"unix_micros(cast({ts} as timestamp))" if self.spark else f"epoch_us({ts})"

    def timestamp(self, us):
        return f"cast(timestamp_micros({us}) as timestamp_ntz)" if self.spark else f"make_timestamp({us})"

    def mod(self, a, b):
        return f"(({a}) % ({b}))" if self.spark else f"fmod({a}, {b})"

    def crc(self):
        if self.spark:
            return crc_sql()
        terms = ", ".join(map(str, bit_syndromes(112)))
        return (f"list_reduce(list_transform(range(1, 113), lambda i: CASE WHEN (CASE WHEN i <= 56 "
                f"THEN (_head >> CAST(56 - i AS BIGINT)) ELSE (_tail >> CAST(112 - i AS BIGINT)) END) & 1 = 1 "
                f"THEN [{terms}][i] ELSE 0 END), lambda a, b: xor(a, b))")


def zones(x: str) -> str:
    return "(59 - (" + " + ".join(f"CASE WHEN abs({x}) >= {t!r} THEN 1 ELSE 0 END" for t in ZONE_LATITUDES) + "))"


def steps(d: Dialect) -> list[dict[str, str]]:
    """Columns added stage by stage; a later stage may use those of an earlier one."""
    h = "md5(cast(event_id as string))" if d.spark else "md5(cast(event_id as varchar))"
    low51 = (1 << 51) - 1
    s1 = {
        "_h": d.long(f"substr({h}, 1, 14)"),
        "_k": d.long(f"substr({h}, 15, 4)"),
        "_j": d.long(f"substr({h}, 19, 4)"),
        "_us": f"coalesce({ORIGIN_US} + {d.div(d.micros('ts') + f' - {ORIGIN_US}', TIME_SCALE)}, 0)",
        "_user": "coalesce(user_id, 0)",
        "_addr": "(4194304 + coalesce(user_id, 0) % 4194304)",
    }
    s2 = {
        "_kind": """CASE event_type
            WHEN 'view' THEN 'position'
            WHEN 'click' THEN CASE WHEN _k % 8 < 2 THEN 'ident' WHEN _k % 8 < 5 THEN 'velocity' WHEN _k % 8 = 5 THEN 'status'
                                   WHEN _k % 8 = 6 THEN 'operation' ELSE 'target' END
            WHEN 'purchase' THEN CASE WHEN _k % 2 = 0 THEN 'commb_alt' ELSE 'commb_id' END
            WHEN 'signup' THEN CASE _k % 4 WHEN 0 THEN 'alt' WHEN 1 THEN 'ident_reply' WHEN 2 THEN 'allcall' ELSE 'surface' END
            ELSE CASE _k % 4 WHEN 0 THEN 'acas_short' WHEN 1 THEN 'acas_long' WHEN 2 THEN 'wrong_bit' ELSE 'noise' END END""",
        "_odd": d.shr("_k", 3) + " % 2",
        "_lat": f"(cast(42000000 + (_user % 100) * 80000 + {d.div('_us - ' + str(ORIGIN_US), 1000)} "
                "+ CASE WHEN _k % 40 = 0 THEN 3000000 ELSE 0 END as double) / 1000000)",
        "_lon": f"(cast(15000000 + (_user % 90) * 100000 + {d.div('_us - ' + str(ORIGIN_US), 800)} as double) / 1000000)",
        "_n": "(_j % 1600 + 41)",
    }
    s3 = {
        "_dlat": "(cast(360 as double) / (60 - _odd))",
        "_alt": f"CASE WHEN _k % 7 = 0 THEN _h & 4079 ELSE {d.shl('_n & 2032', 1)} | 16 | (_n & 15) END",
    }
    s4 = {"_yz": f"cast(floor({d.mod('_lat', '_dlat')} / _dlat * 131072 + 0.5) as bigint)"}
    s5 = {"_rlat": "(_dlat * (cast(_yz as double) / 131072 + floor(_lat / _dlat)))"}
    s6 = {"_dlon": f"(cast(360 as double) / greatest({zones('_rlat')} - _odd, 1))"}
    s7 = {"_xz": f"cast(floor({d.mod('_lon', '_dlon')} / _dlon * 131072 + 0.5) as bigint)"}
    sub = d.shr("_k", 4)
    commb = " ".join(f"WHEN {i} THEN (_h & {keep}) | {fixed}" for i, (keep, fixed) in REGISTER_TEMPLATES.items())
    me = f"""CASE _kind
        WHEN 'position' THEN {d.shl("CASE WHEN _k % 16 = 1 THEN 20 + _j % 3 ELSE 9 + _j % 10 END", 51)} | (_h & {_mask((6, 3))})
             | {d.shl("_alt", 36)} | {d.shl("_odd", 34)} | {d.shl("_yz & 131071", 17)} | (_xz & 131071)
        WHEN 'ident' THEN {d.shl("1 + _j % 4", 51)} | (_h & {low51})
        WHEN 'status' THEN {d.shl("28", 51)} | {d.shl(f"{sub} % 4", 48)} | (_h & {(1 << 48) - 1})
        WHEN 'operation' THEN {d.shl("31", 51)} | {d.shl(f"{sub} % 2", 48)} | {d.shl(f"{d.shr('_k', 5)} % 4", 13)}
             | (_h & CASE WHEN _j % 3 = 0 THEN {((1 << 48) - 1) & ~_mask((41, 3))}
                          ELSE {((1 << 48) - 1) & ~_mask((41, 3), (9, 2), (25, 2))} END)
        WHEN 'target' THEN {d.shl("29", 51)} | {d.shl(f"{sub} % 2", 49)} | (_h & {(1 << 49) - 1})
        WHEN 'surface' THEN {d.shl("5 + _j % 4", 51)} | {d.shl(f"{sub} % 28", 44)} | (_h & {(1 << 44) - 1})
        WHEN 'acas_long' THEN CASE WHEN _j % 2 = 0 THEN {d.shl("48", 48)} | (_h & {(1 << 48) - 1}) ELSE _h END
        WHEN 'noise' THEN _h
        WHEN 'commb_alt' THEN _m WHEN 'commb_id' THEN _m
        ELSE {d.shl("19", 51)} | {d.shl(f"1 + {sub} % 4", 48)} | (_h & {(1 << 48) - 1}) END"""
    small = f"CASE _j % 4 WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 48 ELSE 32 END"
    s8 = {
        "_m": f"""CASE {d.div('_k', 2)} % 8 {commb}
            WHEN 6 THEN {d.shl(small, 48)} | CASE WHEN _j % 4 = 0 THEN _h & {_mask((17, 1), (22, 35))} ELSE _h & {(1 << 48) - 1} END
            ELSE CASE WHEN _j % 4 = 0 THEN 0 ELSE (_h & {_mask((1, 24))}) | {_mask((7, 1))} END END""",
    }
    random27 = "(_h & 134217727)"
    s9 = {
        "_me": me,
        "_long": "_kind NOT IN ('alt', 'ident_reply', 'allcall', 'acas_short')",
        "_clear": "_kind NOT IN ('alt', 'ident_reply', 'acas_short', 'acas_long', 'commb_alt', 'commb_id')",
        "_top": f"""CASE _kind WHEN 'alt' THEN {4 << 27} | {random27} WHEN 'ident_reply' THEN {5 << 27} | {random27}
            WHEN 'allcall' THEN {11 << 27} | {d.shl("_k % 8", 24)} | _addr WHEN 'acas_short' THEN {random27}
            WHEN 'acas_long' THEN {16 << 27} | {random27} WHEN 'commb_alt' THEN {20 << 27} | {random27}
            WHEN 'commb_id' THEN {21 << 27} | {random27}
            ELSE {d.shl("CASE WHEN _j % 9 = 0 THEN 18 ELSE 17 END", 27)} | {5 << 24} | _addr END""",
    }
    # The first 88 (or 32) bits in two words, parity still zero.
    s10 = {
        "_head": f"CASE WHEN _long THEN {d.shl('_top', 24)} | {d.shr('_me', 32)} ELSE cast(0 as bigint) END",
        "_tail": f"CASE WHEN _long THEN {d.shl('_me & 4294967295', 24)} ELSE {d.shl('_top', 24)} END",
    }
    s11 = {"_crc": f"cast({d.crc()} as bigint)"}
    wrong = "CASE WHEN _kind = 'wrong_bit' THEN {0} ELSE cast(0 as bigint) END"
    if d.spark:
        head_bit, tail_bit = "shiftleft(1L, cast(55 - _j % 112 as int))", "shiftleft(1L, cast(111 - _j % 112 as int))"
    else:
        head_bit, tail_bit = "(cast(1 as bigint) << (55 - _j % 112))", "(cast(1 as bigint) << (111 - _j % 112))"
    head_flip = wrong.format(f"CASE WHEN _j % 112 < 56 THEN {head_bit} ELSE cast(0 as bigint) END")
    tail_flip = wrong.format(f"CASE WHEN _j % 112 >= 56 THEN {tail_bit} ELSE cast(0 as bigint) END")
    s12 = {
        "_head": d.xor("_head", head_flip),
        "_tail": d.xor(
            f"_tail | {d.xor('_crc', 'CASE WHEN _clear THEN cast(0 as bigint) ELSE _addr END')}",
            d.xor(tail_flip, "CASE WHEN _kind = 'noise' THEN _j ELSE cast(0 as bigint) END")),
    }
    s13 = {
        "frame": f"CASE WHEN _long THEN {d.hex('_head', 14)} || {d.hex('_tail', 14)} ELSE {d.hex('_tail', 14)} END",
    }
    return [s1, s2, s3, s4, s5, s6, s7, s8, s9, s10, s11, s12, s13]


def outputs(d: Dialect) -> dict[str, str]:
    return {
        "frame_id": "event_id",
        "frame": "frame",
        "ts": d.timestamp("_us"),
        "ts12": f"(_us - {ORIGIN_US}) * 12",
        "signal": "cast(_k % 255 + 1 as double)",
        "source": "CASE _k % 5 WHEN 0 THEN 'Mlat' WHEN 1 THEN 'Beast' ELSE 'Sdr' END",
        "receiver": "CASE _k % 2 WHEN 0 THEN 'north' ELSE 'south' END",
    }


def frames_from_events(events: DataFrame) -> DataFrame:
    """One frame per event: ``frame_id, frame, ts, ts12, signal, source, receiver``."""
    d = Dialect("spark")
    out = events.select("event_id", "ts", "user_id", "event_type")
    for stage in steps(d):
        out = compute_once(out, stage)
    return out.selectExpr(*[f"{sql} AS {name}" for name, sql in outputs(d).items()])


def frames_sql() -> str:
    """The same table for the check engine, as a chain of common table expressions."""
    d = Dialect("check")
    ctes, previous = [], "events"
    for i, stage in enumerate(steps(d)):
        replaced = [n for n in stage if n in ("_head", "_tail") and i > 9]
        star = f"* EXCLUDE ({', '.join(replaced)})" if replaced else "*"
        columns = ", ".join(f"{sql} AS {name}" for name, sql in stage.items())
        ctes.append(f"f{i} AS MATERIALIZED (SELECT {star}, {columns} FROM {previous})")
        previous = f"f{i}"
    final = ", ".join(f"{sql} AS {name}" for name, sql in outputs(d).items())
    return ", ".join(ctes) + f", frames AS MATERIALIZED (SELECT {final} FROM {previous})"


def registry_from_customers(customers: DataFrame) -> DataFrame:
    """Registry dimension: one row per customer, address as for the events' users."""
    return customers.selectExpr(
        "lpad(hex(4194304 + c_custkey % 4194304), 6, '0') AS icao", "c_name AS registration",
        "cast(c_nationkey as string) AS country", "substr(c_mktsegment, 1, 4) AS type_code", "c_mktsegment AS operator_name",
        "c_custkey % 5 = 0 AS military", "c_custkey % 7 = 0 AS ladd", "c_custkey % 11 = 0 AS pia",
    )


REGISTRY_SQL = """registry AS (SELECT upper(lpad(to_hex(4194304 + c_custkey % 4194304), 6, '0')) AS icao, c_name AS registration,
    CAST(c_nationkey AS VARCHAR) AS country, substr(c_mktsegment, 1, 4) AS type_code, c_mktsegment AS operator_name,
    c_custkey % 5 = 0 AS military, c_custkey % 7 = 0 AS ladd, c_custkey % 11 = 0 AS pia FROM customer)"""


#: A flat message table from events, the same text in both dialects.
FLAT_COLUMNS = [
    """CASE event_id % 9 WHEN 0 THEN 'identification' WHEN 1 THEN 'surface_position' WHEN 2 THEN 'airborne_position' WHEN 3 THEN 'velocity'
       WHEN 4 THEN 'altitude_reply' WHEN 5 THEN 'identity_reply' WHEN 6 THEN 'air_air_short' WHEN 7 THEN 'air_air_long' ELSE 'all_call' END AS msg_type""",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('FL', event_id % 1000) END AS callsign",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(floor(value * 10) as int) END AS altitude_ft",
    "CASE WHEN event_id % 6 = 0 THEN NULL ELSE cast(floor(value) as int) END AS speed_kt",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE cast(event_id % 3600 as double) / 10 + 0.04 END AS track",
    "CASE WHEN event_id % 8 = 0 THEN NULL ELSE cast(event_id % 90000 as double) / 1000 + 0.0000004 END AS lat",
    "CASE WHEN event_id % 8 = 0 THEN NULL ELSE cast(event_id % 180000 as double) / 1000 + 0.0000004 END AS lon",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(event_id % 61 - 30 as int) * 64 END AS vertical_rate",
    "lpad(cast(event_id % 7778 as varchar(4)), 4, '0') AS squawk",
    "cast(event_id % 8 as int) AS flight_status",
    "cast(event_id % 24 as int) % 8 AS emergency",
    "event_id % 2 = 0 AS on_ground",
]
