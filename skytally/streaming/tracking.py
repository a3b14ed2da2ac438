"""The whole state of every aircraft in one keyed pass over a stream of frames.

Checking, decoding and the values of all merge rules are stateless columns, computed before the shuffle from the same
rules as the batch state. Addresses are dealt to buckets, and the keyed step works on all rows of a bucket and micro-batch
together: gate, duplicates, sessions, pairs and altitudes are running columns that start anew at every address, and a field
of the state is the value of the last row that touches it. So a call, its numpy steps and its state are paid per bucket, not per
address. State is tables: one row of values per address, and rows for the gates and the frames just heard.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType, TimestampType, _parse_datatype_string

from skytally.operators.aircraft import AIRBORNE, HISTORY_RULES, SECTION_RULES, SURFACE, VELOCITY, in_sections
from skytally.operators.decode import decode_messages
from skytally.operators.folds import _newest, _nm, interval_micros, plausible_sessions
from skytally.operators.frames import validate_frames
from skytally.operators.history import VELOCITY_COLUMNS
from skytally.operators.positions import CPR_SCALE, MAX_RANGE_NM, ZONE_LATITUDES, decode_surface_cpr
from skytally.operators.stages import quoted
from skytally.operators.tracks import MAX_ALTITUDE_FT, MIN_ALTITUDE_FT, POSITION_KINDS, overwrite

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = [r for members in SECTION_RULES.values() for r in members] + [overwrite("signal", "signal"), overwrite("icao", "icao")]
#: What the step needs of every frame besides the values of the rules.
INPUTS = {
    "icao_raw": "icao_raw", "ts": "ts", "frame_id": "frame_id", "frame": "frame", "source": "source", "receiver": "receiver", "msg_type": "msg_type",
    "x_t": "unix_micros(cast(ts AS timestamp))",
    "x_odd": f"CASE WHEN {AIRBORNE} THEN cast(airborne_position.cpr_odd AS double) END",
    "x_cpr_lat": "cast(airborne_position.cpr_lat AS double)", "x_cpr_lon": "cast(airborne_position.cpr_lon AS double)",
    "x_speed": "cast(velocity.speed_kt AS double)",
    "x_baro": "cast(CASE WHEN airborne_position.altitude_type = 'Barometric' THEN airborne_position.altitude_ft END AS double)",
    "x_geo": "cast(CASE WHEN airborne_position.altitude_type = 'Geometric' THEN airborne_position.altitude_ft END AS double)",
    "x_delta": "cast(velocity.geo_delta AS double)",
    "x_reply": "cast(coalesce(altitude_reply.altitude_ft, air_air_short.altitude_ft, air_air_long.altitude_ft) AS double)",
}
#: What the place of a frame from the ground is decoded from.
GROUND = {"x_ground_odd": "surface_position.cpr_odd", "x_ground_cpr_lat": "surface_position.cpr_lat", "x_ground_cpr_lon": "surface_position.cpr_lon"}
#: State of an address besides its fields; times are microseconds.
CARRIED = ("session long, last long, even_lat double, even_lon double, even_t long, odd_lat double, odd_lon double, odd_t long, fold_session long, fold_lat double, "
           "fold_lon double, fold_last long, fold_rejects int, baro_ft int, delta_ft int, geo_ft int, first_seen long, last_position long, total_messages long, "
           "position_messages long, velocity_messages long, identification_messages long, had_mlat boolean, lat double, lon double, position_us long, seq long")
STATE_OUTPUT = ("icao_raw int, session long, frame_id long, baro_ft int, geo_ft int, delta_ft int, had_mlat boolean, lat double, lon double, position_us long, total_messages long, "
                "position_messages long, velocity_messages long, identification_messages long, first_seen long, last_seen long, seen_seconds double, seen_pos_seconds double")
#: What each kind of history needs to be known, and the columns whose change makes an entry.
HISTORIES = {
    "position": (("lat",), ("lat", "lon")),
    "altitude": (("altitude_ft",), ("altitude_ft", "altitude_type")),
    "velocity": (("speed_kt", "ground_speed_kt"), (*VELOCITY_COLUMNS, "speed_type")),
    "state": (("lat",), ("lat", "lon")),
}
#: Addresses are dealt to this many groups by hash. A stream keeps the number for life, whatever the size of the cluster.
BUCKETS = 512
#: Rows of a bucket that are folded at once; an address is not cut.
ROWS_AT_ONCE = 50_000
#: State of a bucket: tables of the open tracks, of the numbers of ended ones, of gates and of frames just heard.
TABLES = "open binary, ended binary, gates binary, heard binary"
RUNNING = "icao string, callsign string, squawk string, baro_ft int, geo_ft int, lat double, lon double, altitude_ft int, altitude_type string, total_messages long"


def flags() -> tuple[dict[str, str], dict[str, str | None]]:
    """A column for each condition of rules that take nulls, and the column of every field (None: null is not taken)."""
    conditions: dict[str, str] = {}
    of = {r.name: conditions.setdefault(r.taken, f"g_{len(conditions)}") if r.overwrite else None for r in RULES}
    return {name: f"coalesce({taken}, false)" for taken, name in conditions.items()}, of


def rule_columns(rows: DataFrame) -> dict[str, str]:
    """SQL of the rules' values (times as microseconds) and conditions."""
    values = {f"v_{r.name}": f"CASE WHEN {r.taken} THEN {r.value} END" for r in RULES}
    for field in rows.selectExpr(*[f"{sql} AS `{name}`" for name, sql in values.items()]).schema.fields:
        if isinstance(field.dataType, TimestampType | TimestampNTZType):
            values[field.name] = f"unix_micros(cast({values[field.name]} AS timestamp))"
    return values | flags()[0]


def track_rows(frames: DataFrame, receiver=None) -> DataFrame:
    """The stateless part: frames checked, decoded and flattened, without a shuffle; surface positions decoded around ``receiver``.

    Frames that do not decode stay in, since the confidence gate counts them. Surface positions come first, on the frames alone:
    after the flattening each of their steps would copy rows of more than a hundred columns, which Spark generates no code for.
    """
    valid = validate_frames(frames).drop("lat", "lon")
    ground = decode_messages(valid, keep_unknown=True, fields={"surface_position": ["cpr_odd", "cpr_lat", "cpr_lon"]}).selectExpr(
        *quoted(valid.columns), *[f"{sql} AS `{name}`" for name, sql in GROUND.items()])
    ground = decode_surface_cpr(ground, *(receiver or (None, None)), "x_ground_cpr_lat", "x_ground_cpr_lon", "x_ground_odd").drop(*GROUND)
    decoded = decode_messages(ground.withColumnsRenamed({"lat": "x_ground_lat", "lon": "x_ground_lon"}), keep_unknown=True)
    return decoded.selectExpr(*[f"{sql} AS `{name}`" for name, sql in (INPUTS | rule_columns(decoded)).items()], "x_ground_lat", "x_ground_lon")


def pair_positions(lat0, lon0, lat1, lon1, odd_newer):
    """Positions of even (0) and odd (1) report pairs as shares of a zone; NaN where the pair does not decode."""
    j = np.floor(59 * lat0 - 60 * lat1 + 0.5)
    north = [6.0 * (np.mod(j, 60) + lat0), 360.0 / 59.0 * (np.mod(j, 59) + lat1)]
    north = [np.where(v >= 270, v - 360, v) for v in north]
    zones = [59 - np.searchsorted(ZONE_LATITUDES, np.abs(v), side="right") for v in north]
    good = (np.abs(north[0]) <= 90) & (np.abs(north[1]) <= 90) & (zones[0] == zones[1])
    n = np.maximum(zones[0] - odd_newer, 1)
    m = np.floor(lon0 * (zones[0] - 1) - lon1 * zones[0] + 0.5)
    east = 360.0 / n * (np.mod(m, n) + np.where(odd_newer, lon1, lon0))
    return np.where(good, np.where(odd_newer, north[1], north[0]), np.nan), np.where(good, np.where(east > 180, east - 360, east), np.nan)


def _none(n: int, text: bool) -> np.ndarray:
    return np.full(n, None, object) if text else np.full(n, np.nan)


def _packed(table: dict[str, np.ndarray]) -> bytes:
    """A table of numbers (NaN for null) and texts as bytes."""
    batch = pa.RecordBatch.from_pydict({name: pa.array(v, pa.string() if v.dtype == object else pa.float64()) for name, v in table.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None, names: list[str], texts: set[str]) -> dict[str, np.ndarray]:
    if data is None:
        return {name: _none(0, name in texts) for name in names}
    batch = pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_next_batch()
    return {name: batch.column(name).to_numpy(zero_copy_only=False) for name in names}


def _joined(tables: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([t[name] for t in tables]) for name in tables[0]}


def _at(table: dict[str, np.ndarray], rows) -> dict[str, np.ndarray]:
    return {name: v[rows] for name, v in table.items()}


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nulls equal nulls."""
    return a != b if a.dtype == object else ~((a == b) | (np.isnan(a) & np.isnan(b)))


def _groups(*codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with equal codes one after the other, otherwise as they are; whether each begins a group, and the group's first place."""
    key = codes[0].astype(np.int64)
    for more in codes[1:]:
        key = key * (int(more.max(initial=0)) + 1) + more
    order = np.argsort(key, kind="stable")
    begin = np.append(True, np.diff(key[order]) != 0)[:len(key)]
    return order, begin, np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))


class TrackProcessor:
    """Folds the frames of the addresses of a bucket; ``emit`` is ``states``, ``messages`` or a kind of history."""

    def __init__(self, fields: dict, emit: str, names: dict, dup_us: int, n: int, gate_us: int, track_us: int, pair_us: int, receiver):
        self.fields = list(fields)
        self.flag_of, self.emit, self.names, self.receiver = flags()[1], emit, names, receiver
        self.dup_us, self.n, self.gate_us, self.track_us, self.pair_us = dup_us, n, gate_us, track_us, pair_us
        kinds = {name: kind.simpleString() for name, kind in fields.items()} | {f.name: f.dataType.simpleString() for f in _parse_datatype_string(RUNNING).fields}
        self.judged = HISTORIES[emit][1] if emit in HISTORIES else ()
        self.carried = [f.name for f in _parse_datatype_string(CARRIED).fields] + [f"v_{name}" for name in fields] + [f"h_{c}" for c in self.judged]
        self.texts = {f"{mark}_{name}" for name, kind in kinds.items() for mark in "vh" if kind == "string"} | {"name"}

    def __call__(self, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [part for part in rows if len(part)]
        held = state.getOption or (None,) * 4
        columns = (["address", "until", *self.carried], ["address", "session"], ["address", "name", "seen", "last"], ["address", "name", "last"])
        held = [_unpacked(data, names, self.texts) for data, names in zip(held, columns, strict=True)]
        if parts:
            batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            del parts
            address = batch["icao_raw"].fillna(-1).to_numpy(np.int64)
            places = np.lexsort([batch["frame_id"].to_numpy(), batch["x_t"].to_numpy(), address])
            batch, address = batch.take(places).reset_index(drop=True), address[places]
            starts = np.flatnonzero(np.append(True, np.diff(address) != 0))
            low, after = 0, []
            while low < len(starts):
                high = max(low + 1, int(np.searchsorted(starts, starts[low] + ROWS_AT_ONCE)))
                end = starts[high] if high < len(starts) else len(batch)
                own = address[starts[low:high]]
                piece = slice(starts[low], end)
                out, *known = self.step(batch.iloc[piece].reset_index(drop=True), np.searchsorted(own, address[piece]), own, held)
                after.append(known)
                if len(out):
                    yield out
                low = high
            heard_from = address[starts]
            held = [_joined([_at(old, ~np.isin(old["address"], heard_from)), *new]) for old, new in zip(held, zip(*after, strict=True), strict=True)]
        self.keep(held, state)

    def keep(self, tables: list[dict], state: GroupState) -> None:
        """Of a track that is over the number is left, so the next one counts on. The timer is that of the next track to end."""
        tracks, ended, gates, heard = tables
        watermark = state.getCurrentWatermarkMs()
        over = tracks["until"] <= watermark
        gone = tracks["address"][over]
        numbered = over & ~np.isnan(tracks["session"])
        ended = _joined([ended, {c: tracks[c][numbered] for c in ("address", "session")}])
        tracks = _at(tracks, ~over)
        gates, heard = (_at(t, ~np.isin(t["address"], gone)) for t in (gates, heard))
        state.update(tuple(_packed(t) for t in (tracks, ended, gates, heard)))
        if len(tracks["until"]):
            state.setTimeoutTimestamp(int(tracks["until"].min()))

    def step(self, batch: pd.DataFrame, of: np.ndarray, own: np.ndarray, held: list[dict]) -> tuple:
        """All rows of some addresses, ordered, ``of`` the place of a row's address in ``own``; rows out, and the addresses' tables."""
        tracks, ended, gates, heard = held
        t = batch["x_t"].to_numpy(np.int64)
        place = pd.Index(tracks["address"]).get_indexer(own)
        known = {c: _none(len(own), c in self.texts) for c in self.carried}
        for c in self.carried:
            known[c][place >= 0] = tracks[c][place[place >= 0]]
        over = pd.Index(ended["address"]).get_indexer(own)
        known["session"][over >= 0] = ended["session"][over[over >= 0]]
        newest = t[np.append(of[1:] != of[:-1], True)]
        until = (newest + max(self.track_us, self.gate_us, self.pair_us, self.dup_us)) // 1000 + 1
        passed, gates, heard = self.passing(batch, t, of, own, newest, gates, heard)
        passed &= batch["msg_type"].notna().to_numpy()
        out = ()
        if passed.any():
            out, touched, after = self.fold(batch[passed].reset_index(drop=True), of[passed], known)
            for c in self.carried:
                known[c][touched] = after[c]
        nothing = {c: np.zeros(0) for c in ("address", "session")}
        return out, {"address": own.astype(float), "until": until.astype(float), **known}, nothing, gates, heard

    def passing(self, batch: pd.DataFrame, t: np.ndarray, of: np.ndarray, own: np.ndarray, newest: np.ndarray, gates: dict, heard: dict) -> tuple:
        """Rows that pass the gate of their source and are no repeats for their receiver; the addresses' gates and frames just heard."""
        gates, heard = (_at(table, np.isin(table["address"], own)) for table in (gates, heard))
        source = batch["source"].to_numpy()

        # What a gate has seen goes in as a row before those of the batch.
        k = len(gates["address"])
        codes, names = pd.factorize(np.append(gates["name"], np.where(source == "Mlat", "Sdr", source).astype(str)))
        of_gate = np.append(np.searchsorted(own, gates["address"]), of)
        order, begin, first = _groups(of_gate, codes)
        times = np.append(gates["last"].astype(np.int64), t)[order]
        weight = np.append(gates["seen"].astype(np.int64), np.where(source == "Mlat", self.n, 1))[order]
        anew = begin | (np.diff(times, prepend=times[:1]) > self.gate_us)
        start = np.maximum.accumulate(np.where(anew, np.arange(len(order)), 0))
        total = np.cumsum(weight)
        total = total - total[start] + weight[start]
        passed = np.zeros(k + len(t), bool)
        passed[order] = total >= self.n
        passed = passed[k:]
        last = np.append(begin[1:], True)
        at = order[last]
        gates = {"address": own[of_gate[at]].astype(float), "name": names[codes[at]].astype(object), "seen": total[last].astype(float), "last": times[last].astype(float)}

        # So do the frames just heard.
        at = np.flatnonzero(passed & (source == "Sdr"))
        k = len(heard["address"])
        frame = (batch["receiver"].iloc[at].astype(str) + " " + batch["frame"].iloc[at]).to_numpy(object)
        codes, names = pd.factorize(np.append(heard["name"], frame))
        of_frame = np.append(np.searchsorted(own, heard["address"]), of[at])
        order, begin, _ = _groups(of_frame, codes)
        times = np.append(heard["last"].astype(np.int64), t[at])[order]
        again = np.zeros(k + len(at), bool)
        again[order] = ~begin & (np.diff(times, prepend=times[:1]) <= self.dup_us)
        passed[at[again[k:]]] = False
        last = np.append(begin[1:], True)[:len(order)]
        last &= newest[of_frame[order]] - times <= self.dup_us
        at = order[last]
        heard = {"address": own[of_frame[at]].astype(float), "name": np.asarray(names, object)[codes[at]], "last": times[last].astype(float)}
        return passed, gates, heard

    def fold(self, batch: pd.DataFrame, of: np.ndarray, known: dict) -> tuple[pd.DataFrame, np.ndarray, dict]:
        """Rows out, the places of the addresses that have rows, and their state after them; ``known`` is the state of all before."""
        n, t, kind = len(batch), batch["x_t"].to_numpy(np.int64), batch["msg_type"].to_numpy()
        begin = np.append(True, of[1:] != of[:-1])
        head = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
        tails = np.flatnonzero(np.append(begin[1:], True))
        touched = of[tails]
        before = {c: known[c][of] for c in self.carried if not c.startswith(("v_", "h_"))}
        was = np.nan_to_num(before["session"]).astype(np.int64)
        fresh = (begin & np.isnan(before["last"])) | (t - np.where(begin, before["last"], np.roll(t, 1)) > self.track_us)
        total = np.cumsum(fresh)
        session = total - total[head] + fresh[head] + was
        start = np.maximum.accumulate(np.where(fresh | begin, np.arange(n), 0))
        goes_on = session == was

        def number(name):
            return batch[name].to_numpy(float, na_value=np.nan)

        def running(values, taken, carried):
            at = _newest(taken, start)
            return np.where(at >= 0, values[at], np.where(goes_on, carried, np.nan))

        def field(name, rows):
            """A field of the state after the given rows."""
            text = f"v_{name}" in self.texts
            values = batch[f"v_{name}"].to_numpy(object) if text else number(f"v_{name}")
            taken = batch[self.flag_of[name]].to_numpy(bool) if self.flag_of[name] else batch[f"v_{name}"].notna().to_numpy()
            at, none = _newest(taken, start)[rows], None if text else np.nan
            out = np.where(goes_on[rows], known[f"v_{name}"][of[rows]], none)
            out[at >= 0] = values[at[at >= 0]]
            if text:
                out[pd.isna(out)] = None
            return out

        velocity, surface = kind == "velocity", kind == "surface_position"
        reports = np.isin(kind, POSITION_KINDS)
        speed = running(number("x_speed"), velocity, known["v_speed_kt"][of])

        # Pairs are of the address, whatever the track.
        odd, cpr = number("x_odd"), {}
        for name, flag in (("even", 0), ("odd", 1)):
            at = _newest(odd == flag, head)
            for c, values in (("lat", number("x_cpr_lat")), ("lon", number("x_cpr_lon")), ("t", t.astype(float))):
                cpr[f"{name}_{c}"] = np.where(at >= 0, values[at], before[f"{name}_{c}"])
        with np.errstate(invalid="ignore"):
            paired = (np.abs(cpr["even_t"] - cpr["odd_t"]) < self.pair_us) & (kind == "airborne_position")
            lat, lon = pair_positions(*(np.where(paired, cpr[c], np.nan) / CPR_SCALE for c in ("even_lat", "even_lon", "odd_lat", "odd_lon")), cpr["odd_t"] > cpr["even_t"])
            if self.receiver:
                far = _nm(*self.receiver, lat, lon) > MAX_RANGE_NM
                lat, lon = np.where(far, np.nan, lat), np.where(far, np.nan, lon)
        lat, lon = np.where(surface, number("x_ground_lat"), lat), np.where(surface, number("x_ground_lon"), lon)
        at = np.flatnonzero(reports)
        entered = before["fold_session"] == session
        entry = [np.where(entered, before[f"fold_{c}"], nothing)[at] for c, nothing in (("lat", np.nan), ("lon", np.nan), ("last", np.nan), ("rejects", 0))]
        columns = {"_t": t, "_lat": lat, "_lon": lon, "_speed": speed, "_surface": surface, "_session": np.cumsum(fresh | begin)}
        fix_lat, fix_lon, fix_us, _, rejects = plausible_sessions({c: v[at] for c, v in columns.items()}, entry, self.track_us // 2)
        fix_us = np.where(fix_us < 0, np.nan, fix_us)
        place, fold = {}, {}
        for name, values in (("lat", fix_lat), ("lon", fix_lon), ("position_us", fix_us)):
            place[name] = running(self.spread(values, at, n), reports, before[name])
        newest = _newest(reports, head)[tails]
        for name, values in (("session", session[at]), ("lat", fix_lat), ("lon", fix_lon), ("last", fix_us), ("rejects", rejects)):
            # Half a position is none.
            values = np.where(np.isnan(fix_lat), np.nan, values) if name == "lon" else values
            fold[f"fold_{name}"] = np.where(newest >= 0, self.spread(values, at, n)[newest], known[f"fold_{name}"][touched])

        baro, geo = number("x_baro"), number("x_geo")
        both = np.where(np.isnan(baro), number("x_reply"), baro)
        baro_ft = running(both, ~np.isnan(both), before["baro_ft"])
        delta = np.where(np.isnan(geo - baro_ft), np.where(np.isnan(geo) | np.isnan(baro_ft), number("x_delta"), np.nan), geo - baro_ft)
        delta_ft = running(delta, ~np.isnan(delta), before["delta_ft"])
        derived = baro + delta_ft
        with np.errstate(invalid="ignore"):
            geo = np.where(np.isnan(geo), np.where((derived >= MIN_ALTITUDE_FT) & (derived <= MAX_ALTITUDE_FT), derived, np.nan), geo)
        geo_ft = running(geo, ~np.isnan(geo), before["geo_ft"])

        def count(mask, name):
            total = np.cumsum(mask)
            return total - total[start] + mask[start] + np.where(goes_on, np.nan_to_num(before[name]), 0)

        mlat = reports & (batch["source"].to_numpy() == "Mlat")
        after = {
            "baro_ft": baro_ft, "delta_ft": delta_ft, "geo_ft": geo_ft, **place, "last_position": running(t.astype(float), reports, before["last_position"]),
            "first_seen": np.where(goes_on & ~np.isnan(before["first_seen"]), before["first_seen"], t[start]), "total_messages": count(np.ones(n, bool), "total_messages"),
            "position_messages": count(reports, "position_messages"), "velocity_messages": count(velocity, "velocity_messages"),
            "identification_messages": count(kind == "identification", "identification_messages"),
            "had_mlat": count(mlat, "had_mlat") > 0, "seq": np.where(goes_on, np.nan_to_num(before["seq"]), 0),
            "session": session, "last": t, **cpr,
        }
        heads = {"icao_raw": batch["icao_raw"].to_numpy(), "session": session, "ts": t, "frame_id": batch["frame_id"].to_numpy(), "msg_type": kind}
        state = {c: v[tails].astype(float) for c, v in after.items()} | fold
        if self.emit == "states":
            ends = np.flatnonzero(np.append(session[1:] != session[:-1], True) | np.append(begin[1:], True))
            fields = {name: field(name, ends) for name in self.fields}
            out = {**_at(heads, ends), **_at(after, ends), **fields, "last_seen": t[ends], "seen_seconds": (t[ends] - after["first_seen"][ends]) / 1e6,
                   "seen_pos_seconds": (t[ends] - after["last_position"][ends]) / 1e6}
            state |= {f"v_{name}": v[np.searchsorted(ends, tails)] for name, v in fields.items()}
        else:
            known_ft = np.where(np.isnan(baro_ft), geo_ft, baro_ft)
            running_columns = heads | after | {
                "altitude_ft": known_ft, "altitude_type": np.where(~np.isnan(baro_ft), "Barometric", np.where(~np.isnan(geo_ft), "Geometric", None))}

            def column(name, rows):
                return running_columns[name][rows] if name in running_columns else field(name, rows)

            rows, more = np.arange(n), {}
            if self.emit in HISTORIES:
                rows, more, judged = self.changes(column, of, begin, session, goes_on, tails, known)
                state |= judged
            out = {name: column(name, rows) for name in self.names if name not in more} | more
            state |= {f"v_{name}": field(name, tails) for name in self.fields}
        return self.frame(out), touched, state

    @staticmethod
    def spread(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, np.nan)
        out[at] = values
        return out

    def frame(self, columns: dict) -> pd.DataFrame:
        """Columns of the output's types, null where a number is NaN."""
        out = {}
        for name, kind in self.names.items():
            values = columns[name]
            if kind == "boolean" and values.dtype != bool:
                values = pd.arrays.BooleanArray(values == 1, pd.isna(values))
            elif kind in ("int", "bigint", "smallint", "tinyint") and values.dtype.kind == "f":
                gone = np.isnan(values)
                values = pd.arrays.IntegerArray(np.where(gone, 0, values).astype(np.int64), gone)
            out[name] = values
        return pd.DataFrame(out)

    def changes(self, column, of: np.ndarray, begin: np.ndarray, session: np.ndarray, goes_on: np.ndarray, tails: np.ndarray, known: dict) -> tuple[np.ndarray, dict, dict]:
        """Rows that change the history, their numbers within their track, and what the next batch compares with."""
        every, had = np.arange(len(of)), np.nan_to_num(known["seq"]).astype(np.int64)
        values = {c: column(c, every) for c in dict.fromkeys([*HISTORIES[self.emit][0], *self.judged])}
        at = np.flatnonzero(np.logical_or.reduce([~pd.isna(values[c]) for c in HISTORIES[self.emit][0]]))
        address, track, on = of[at], session[at], goes_on[at] & (had[of[at]] > 0)
        edge = np.append(True, (address[1:] != address[:-1]) | (track[1:] != track[:-1]))[:len(at)]
        start = np.maximum.accumulate(np.where(edge, np.arange(len(at)), 0))
        first = edge & ~on
        new, held, newest = first.copy(), {}, np.searchsorted(at, tails, side="right") - 1
        # The newest known row of an address, if it has one in the batch.
        own = (newest >= 0) & (address[newest] == of[tails]) if len(at) else np.zeros(len(tails), bool)
        for c in self.judged:
            mine = values[c][at]
            new |= _differ(mine, np.where(edge, known[f"h_{c}"][address], np.roll(mine, 1)))
            held[f"h_{c}"] = known[f"h_{c}"][of[tails]]
            held[f"h_{c}"][own] = mine[newest[own]]
        total = np.cumsum(new)
        seq = total - total[start] + new[start] + np.where(first[start], 0, had[address])
        # Entries of the track that is open at the end of the batch; none if it has no known row yet.
        held["seq"] = np.where(goes_on[tails], had[of[tails]], 0).astype(float)
        open_still = own.copy()
        open_still[own] = track[newest[own]] == session[tails[own]]
        held["seq"][open_still] = seq[newest[open_still]]
        return at[new], {"seq": seq[new], "kind": np.full(int(new.sum()), self.emit, object)}, held


def _keyed(frames: DataFrame, emit: str, output, window, n, gate_timeout, track_timeout, pair_age, receiver) -> DataFrame:
    rows = frames if "x_t" in frames.columns else track_rows(frames, receiver)
    limits = [interval_micros(rows.sparkSession, v) for v in (window, gate_timeout, track_timeout, pair_age)]
    fields = {f.name[2:]: f.dataType for f in rows.schema.fields if f.name.startswith("v_")}
    schema = output(fields)
    # Only fields that come out are carried and shuffled: a step's time follows its columns.
    fields = {name: kind for name, kind in fields.items() if emit == "states" or name in schema.names}
    needed = {f"v_{name}" for name in fields} | {flag for name, flag in flags()[1].items() if name in fields}
    rows = rows.select(*[c for c in rows.columns if not c.startswith(("v_", "g_")) or c in needed])
    names = {f.name: f.dataType.simpleString() for f in schema.fields}
    processor = TrackProcessor(fields, emit, names, limits[0], n, *limits[1:], tuple(map(float, receiver)) if receiver else None)

    def step(key, parts, state):
        yield from processor(parts, state)

    # Times leave as microseconds, since those of pandas are local and come back otherwise in the hour that a clock is set back.
    schema = StructType([StructField(f.name, LongType()) if f.name == "ts" else f for f in schema.fields])
    dealt = rows.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(icao_raw), {BUCKETS}) AS int)"))
    out = dealt.groupBy("bucket").applyInPandasWithState(step, schema, TABLES, "Append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("ts", F.timestamp_micros("ts")) if "ts" in out.columns else out


def state_stream(frames: DataFrame, window="50 milliseconds", n: int = 10, gate_timeout="30 seconds", track_timeout="60 seconds",
                 pair_age="10 seconds", receiver=None) -> DataFrame:
    """The sections of ``aircraft_state`` for every track that a micro-batch touched, as known after it.

    ``frames`` (or its ``track_rows``) is a stream with a watermark on ``ts``. The newest row, that of the most
    ``status.total_messages``, of a track is its state. An address silent for the time-out keeps only the number of its last track.
    """
    def output(fields):
        return StructType([*_parse_datatype_string(STATE_OUTPUT).fields, *[StructField(name, kind) for name, kind in fields.items()]])

    out = _keyed(frames, "states", output, window, n, gate_timeout, track_timeout, pair_age, receiver)
    times = [r.name for r in RULES if r.name.endswith("_ts")] + ["first_seen", "last_seen"]
    out = out.withColumns({c: F.timestamp_micros(c) for c in times}).withColumn("position_ts", F.timestamp_micros("position_us").cast("timestamp_ntz"))
    return in_sections(out, SECTION_RULES)


def track_stream(frames: DataFrame, window="50 milliseconds", n: int = 10, gate_timeout="30 seconds", track_timeout="60 seconds",
                 pair_age="10 seconds", receiver=None, history: str | None = None) -> DataFrame:
    """Every message that passes with the track as known after it; with ``history`` the numbered changes of that kind.

    Columns are those of ``tracked_rows`` with callsign, squawk and message count; a history has ``kind`` and ``seq`` too.
    """
    if history is not None and history not in HISTORIES:
        raise ValueError(f"unknown history: {history}")

    def output(fields):
        head = _parse_datatype_string("icao_raw int, session long, ts timestamp, frame_id long, msg_type string").fields
        more = _parse_datatype_string("kind string, seq long").fields if history else []
        return StructType([*head, *_parse_datatype_string(RUNNING).fields, *[StructField(r.name, fields[r.name]) for r in HISTORY_RULES], *more])

    return _keyed(frames, history or "messages", output, window, n, gate_timeout, track_timeout, pair_age, receiver)
