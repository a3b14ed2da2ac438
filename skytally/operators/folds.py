"""Ordered folds: results that depend on what was accepted or emitted before.

No window expresses these, so sorted partitions stream through a small numpy kernel as Arrow
batches; the kernel runs per (key, slice) group and its state is carried from batch to batch. Hot keys are
folded slice by slice in parallel: a kernel can say what a slice makes of the states it may be entered
with (``transfer``), so there is one pass for that and one to write the result, however many slices there are. A slice
whose summary does not tell (``UNKNOWN``) is run by itself from the state it is entered with. The end is always the exact
sequential result.
"""

from __future__ import annotations

import bisect
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from skytally.operators.ordered import as_list, is_sliced, micros, partition_columns, slice_of
from skytally.operators.stages import cut_lineage


@dataclass(frozen=True)
class Kernel:
    """``step(columns, state) -> (outputs, state)`` over one batch in order.

    ``columns`` are numpy arrays (nulls as NaN), ``state`` a tuple or None at the start.
    ``transfer(columns)`` describes a whole slice as two lists of ``numbers``, and ``through(lists, state)``
    gives the state it is left with, or ``UNKNOWN``. ``steps(columns, starts, state) -> (outputs, state)`` is ``step`` over
    all groups of a batch together, if the kernel can do that: ``starts`` are the rows at which a group begins, ``state`` is that
    of the first group, the state it returns that of the last one.
    """

    inputs: tuple[str, ...]
    state: str
    output: str
    step: Callable
    transfer: Callable
    through: Callable
    numbers: str = "bigint"
    steps: Callable | None = None


UNKNOWN = ("unknown",)


# Kernels travel to the Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ARROW = {"boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _starts(batch: pa.RecordBatch, part: list[str]) -> list[int]:
    """Rows of a batch at which a new group begins, the first row included."""
    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    for name in part:
        codes = pc.dictionary_encode(batch.column(batch.schema.get_field_index(name))).indices
        codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change).tolist()


def _groups(batches: Iterator[pa.RecordBatch], part: list[str], inputs, step) -> Iterator[tuple]:
    """Run the kernel over sorted batches, group by group, carrying a group's state into the next batch.

    Yields ``(batch, [(key, outputs, state), ...])`` with one entry per group in the batch.
    """
    open_key, state = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = {c: _numpy(batch, c) for c in inputs}
        labels = [batch.column(batch.schema.get_field_index(c)) for c in part]
        entry_index = batch.schema.get_field_index("_entry")
        starts = _starts(batch, part)
        done = []
        for low, high in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(column[low].as_py() for column in labels)
            if key != open_key:
                entry = batch.column(entry_index)[low].as_py() if entry_index >= 0 else None
                open_key, state = key, None if entry is None else tuple(entry.values())
            outputs, state = step({c: v[low:high] for c, v in columns.items()}, state)
            done.append((key, outputs, state))
        yield batch, done


def _whole_batches(batches: Iterator[pa.RecordBatch], part: list[str], inputs, steps) -> Iterator[tuple]:
    """``_groups`` with all groups of a batch in one call, entered without a state: ``(batch, [(key, outputs, state)])`` of the last one."""
    open_key, state = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        labels = [batch.column(batch.schema.get_field_index(c)) for c in part]
        first, last = (tuple(column[at].as_py() for column in labels) for at in (0, batch.num_rows - 1))
        outputs, state = steps({c: _numpy(batch, c) for c in inputs}, _starts(batch, part), state if first == open_key else None)
        open_key = last
        yield batch, [(last, outputs, state)]


def _in_order(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    # All rows of a group in one partition, groups one after the other, each in order.
    return df.repartition(*part).sortWithinPartitions(*part, *order)


def _run(df: DataFrame, part, order, kernel: Kernel) -> DataFrame:
    added = _parse_datatype_string(kernel.output)
    kept = [f for f in df.schema.fields if f.name != "_entry"]
    names, out_names = [f.name for f in kept], [f.name for f in added.fields]
    inputs, part = kernel.inputs, list(part)
    types = [_ARROW[f.dataType.simpleString()] for f in added.fields]
    walk, step = (_whole_batches, kernel.steps) if kernel.steps and "_entry" not in df.columns else (_groups, kernel.step)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, done in walk(batches, part, inputs, step):
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for name, kind in zip(out_names, types):
                parts = [outputs[name] for _, outputs, _ in done]
                values = np.concatenate(parts) if isinstance(parts[0], np.ndarray) else [v for p in parts for v in p]
                arrays.append(pa.array(values, type=kind, from_pandas=True))
            yield pa.RecordBatch.from_arrays(arrays, names=names + out_names)

    return _in_order(df, part, order).mapInArrow(apply, StructType(kept + added.fields))


def _end_states(df: DataFrame, part, order, kernel: Kernel) -> DataFrame:
    fields = _parse_datatype_string(kernel.state).fields
    keys = [df.schema[c] for c in part]
    inputs, step, part = kernel.inputs, kernel.step, list(part)
    names = part + [f.name for f in fields]
    state_types = [_ARROW[f.dataType.simpleString()] for f in fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended, key_types = {}, None
        for batch, done in _groups(batches, part, inputs, step):
            key_types = [batch.schema.field(c).type for c in part]
            # A group that goes on in the next batch is simply written again.
            ended.update({key: state for key, _, state in done})
        if ended:
            columns = list(zip(*[(*key, *state) for key, state in ended.items()]))
            arrays = [pa.array(v, type=t) for v, t in zip(columns, [*key_types, *state_types])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return _in_order(df, part, order).mapInArrow(apply, StructType(keys + fields))


def _transfers(df: DataFrame, part, order, kernel: Kernel) -> DataFrame:
    """One row per slice with the two lists of ``transfer``."""
    keys = [df.schema[c] for c in part]
    inputs, transfer, part, kind = kernel.inputs, kernel.transfer, list(part), _ARROW[kernel.numbers]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = [], None

        def whole() -> pa.RecordBatch:
            columns = {c: np.concatenate([h[c] for h in held]) for c in inputs}
            lists = [pa.array([list(x)], pa.list_(kind)) for x in transfer(columns)]
            return pa.RecordBatch.from_arrays([pa.array([k], t) for k, t in zip(open_key, types)] + lists, names=[*part, "_at", "_exit"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.schema.field(c).type for c in part]
            columns = {c: _numpy(batch, c) for c in inputs}
            labels = [batch.column(batch.schema.get_field_index(c)) for c in part]
            starts = _starts(batch, part)
            for low, high in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(column[low].as_py() for column in labels)
                if held and key != open_key:
                    yield whole()
                    held = []
                open_key = key
                held.append({c: v[low:high] for c, v in columns.items()})
        if held:
            yield whole()

    lists = _parse_datatype_string(f"_at array<{kernel.numbers}>, _exit array<{kernel.numbers}>").fields
    return _in_order(df, part, order).mapInArrow(apply, StructType([*keys, *lists]))


def _chain(keys) -> list:
    """Slices in order, those of a key one after the other."""
    return sorted(keys, key=lambda k: (tuple(map(repr, k[:-1])), k[-1]))


def fold(df: DataFrame, keys, order, kernel: Kernel) -> DataFrame:
    """Add the kernel's outputs to every row, folding each key in the given total order."""
    keys, order = as_list(keys), as_list(order)
    part = partition_columns(df, keys)
    if not is_sliced(df, keys):
        return _run(df, part, order, kernel)

    spark = df.sparkSession
    slice_name = slice_of(df, keys)
    fields = _parse_datatype_string(kernel.state).fields
    narrow = list(dict.fromkeys([*part, *order, *kernel.inputs]))
    hot = cut_lineage(df.where(F.col(slice_name) > 0).select(*narrow))
    label_schema = StructType([df.schema[c] for c in part])

    def key_of(row):
        return tuple(row[c] for c in part)

    def state_of(row):
        return tuple(row[f.name] for f in fields)

    def table(entries: dict):
        # At most two rows per cut.
        schema = StructType([*label_schema.fields, StructField("_entry", StructType(fields))])
        return spark.createDataFrame([(*k, v) for k, v in entries.items()], schema)

    def with_entries(rows: DataFrame, entries: dict, how: str) -> DataFrame:
        right = table(entries).select(*[F.col(c).alias(f"_at_{c}") for c in part], "_entry")
        match = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in part]
        return rows.join(right, match, how).drop(*[f"_at_{c}" for c in part])

    found = {key_of(r): (r["_at"], r["_exit"]) for r in _transfers(hot, part, order, kernel).collect()}
    known: dict = {}
    while True:
        entries: dict = {}
        before, state, untold = None, None, {}
        for k in _chain(found):
            state = state if before == k[:-1] else None
            before = k[:-1]
            if state is UNKNOWN:
                continue
            entries[k] = state
            state = known[k] if k in known else kernel.through(found[k], state)
            if state is UNKNOWN:
                untold[k] = entries[k]
        if not untold:
            return _run(with_entries(df, entries, "left"), part, order, kernel)
        rerun = _end_states(with_entries(hot, untold, "inner"), part, order, kernel)
        known.update({key_of(r): state_of(r) for r in rerun.collect()})


# --- rate limit -------------------------------------------------------------------------


def rate_limit(df: DataFrame, key, ts: str, every: str = "1 second", order=None, eligible=None, forced=None,
               output: str = "emit") -> DataFrame:
    """Flag rows to emit: at most one per key and interval, measured from the last emitted row.

    ``eligible`` (a boolean column) names the rows that may be emitted, all by default.
    ``forced`` rows are emitted always and restart the interval.
    """
    every_us = interval_micros(df.sparkSession, every)
    source = df.withColumns({
        "_t": micros(ts),
        "_may": F.lit(True) if eligible is None else F.coalesce(F.col(eligible), F.lit(False)),
        "_must": F.lit(False) if forced is None else F.coalesce(F.col(forced), F.lit(False)),
    })

    def step(columns, state):
        t, may, must = columns["_t"], columns["_may"], columns["_must"]
        last = None if state is None or state[0] is None else int(state[0])
        emit = np.zeros(len(t), dtype=bool)
        if must.any():
            for i in range(len(t)):
                if must[i] or (may[i] and (last is None or t[i] - last >= every_us)):
                    emit[i], last = True, int(t[i])
        else:
            index = np.flatnonzero(may)
            times = t[index]
            i = 0 if last is None else int(np.searchsorted(times, last + every_us, side="left"))
            while i < len(times):
                emit[index[i]], last = True, int(times[i])
                i = max(i + 1, int(np.searchsorted(times, last + every_us, side="left")))
        return {output: emit}, (last,)

    def transfer(columns):
        """Times at which a first emission leads to another end, and those ends."""
        t, may, must = columns["_t"], columns["_may"], columns["_must"]
        if must.any():  # whatever was emitted before, a forced row starts the interval anew
            _, (last,) = step(columns, None)
            return [], [last]
        times = t[may]
        if not len(times):
            return [], []
        first = int(np.searchsorted(times, times[0] + every_us, side="left")) + 1
        place = np.arange(min(first, len(times)))
        way = np.arange(len(place))  # chains that met go on as one
        while True:
            onward = np.maximum(place + 1, np.searchsorted(times, times[place] + every_us, side="left"))
            going = onward < len(times)
            if not going.any():
                break
            place, merged = np.unique(np.where(going, onward, place), return_inverse=True)
            way = merged[way]
        ends = times[place][way]
        keep = np.append(ends[1:] != ends[:-1], True)
        return times[: len(way)][keep].tolist(), ends[keep].tolist()

    def through(lists, state):
        at, ends = lists
        last = None if state is None else state[0]
        if not ends:
            return state
        if not at:
            return (ends[0],)
        i = 0 if last is None else bisect.bisect_left(at, last + every_us)
        return (ends[i],) if i < len(ends) else state

    kernel = Kernel(("_t", "_may", "_must"), "last_us long", f"`{output}` boolean", step, transfer, through)
    return fold(source, key, order or [ts], kernel).drop("_t", "_may", "_must")


def interval_micros(spark, interval) -> int:
    """Length of an interval given as text (``"50 milliseconds"``) or seconds."""
    if isinstance(interval, (int, float)):
        return int(interval * 1_000_000)
    number, unit = interval.split()
    scale = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
             "hour": 3_600_000_000, "day": 86_400_000_000}[unit.rstrip("s")]
    return int(float(number) * scale)


# --- plausible positions ----------------------------------------------------------------

DEFAULT_SPEED_KT = 900.0
MAX_REJECTIONS = 4
_RADIUS_NM = 3440.065


def _nm(lat1, lon1, lat2, lon2):
    rad = math.pi / 180.0
    s1, s2 = np.sin((lat2 - lat1) * rad / 2.0), np.sin((lon2 - lon1) * rad / 2.0)
    a = s1 * s1 + np.cos(lat1 * rad) * np.cos(lat2 * rad) * s2 * s2
    return _RADIUS_NM * 2.0 * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a))


def _within(lat1, lon1, last, lat2, lon2, t, speed, bypass_us: int):
    """Whether a report is plausible after a position of time ``last``."""
    allowed = ((t - last) / 1e6 + 1.0) * np.where(np.isnan(speed), DEFAULT_SPEED_KT, speed) / 3600.0
    return (t - last > bypass_us) | (_nm(lat1, lon1, lat2, lon2) <= allowed)


def _judge(state, report, bypass_us: int):
    """One report: the state after it (latitude, None without a position; longitude; time of last change; rejections) and whether it was taken."""
    lat, lon, last, rejects = state
    t, new_lat, new_lon, speed, surface = report
    known = new_lat == new_lat
    if surface:
        return ((new_lat, new_lon) if known else (lat, lon)) + (t, rejects), known
    if lat is None or last is None or _within(lat, lon, last, new_lat, new_lon, t, speed, bypass_us):
        changed = lat is None or lat != new_lat or lon != new_lon
        return (new_lat, new_lon, t if changed else last, 0), True
    return ((None, None, t, 0) if rejects >= MAX_REJECTIONS else (lat, lon, last, rejects + 1)), False


def _newest(taken: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Index of the newest row with ``taken``, not before the row's ``start``; -1 if there is none."""
    at = np.maximum.accumulate(np.where(taken, np.arange(len(taken)), -1))
    return np.where(at >= start, at, -1)


def _state_in(state, session):
    """Latitude, longitude, last change and rejections of a state handed to ``session``; of another session nothing is left."""
    if state is None or state[0] is None or int(state[0]) != session:
        return None, None, None, 0
    lat, lon, last = (None if v is None or v != v else v for v in state[1:4])
    return lat, lon, None if last is None else int(last), int(state[4])


def plausible_sessions(columns, entry, bypass_us: int):
    """The position filter over rows of many sessions, one after the other; no two of them share a number.

    ``entry`` is the state that a row's session is entered with, as columns: latitude, longitude, time of last change (NaN for none) and
    rejections. What the state would be if every report since the session began were taken is computed for all rows together.
    Reports are judged one by one only from a report that would not be taken, or a state handed in, on until both agree again.
    Latitude, longitude, time of last change (-1 for none), whether taken, and rejections after every row.
    """
    n, session = len(columns["_t"]), columns["_session"]
    surface = columns["_surface"].astype(bool)
    rows = np.flatnonzero(surface | ~np.isnan(columns["_lat"]))
    m, at, of, ground = len(rows), columns["_t"][rows].astype(np.int64), session[rows], surface[rows]
    lat, lon, speed = (columns[c][rows].astype(float) for c in ("_lat", "_lon", "_speed"))
    known, fresh = ~np.isnan(lat), np.ones(m, bool)
    fresh[1:] = of[1:] != of[:-1]
    start = np.maximum.accumulate(np.where(fresh, np.arange(m), 0))

    # If all were taken: the row that gave the position, and the one that last changed it; -1 for none.
    place = _newest(known, start)
    before = np.where(fresh, -1, np.roll(place, 1))
    change = _newest(ground | (known & ((before < 0) | (lat != lat[before]) | (lon != lon[before]))) if m else ground, start)
    changed = np.where(fresh, -1, np.roll(change, 1))
    with np.errstate(invalid="ignore"):
        taken = ground | (before < 0) | (changed < 0) | _within(lat[before], lon[before], at[changed], lat, lon, at, speed, bypass_us) if m else ground
    handed = fresh & ~(np.isnan(entry[0]) & np.isnan(entry[1]) & np.isnan(entry[2]) & (entry[3] == 0))[rows]
    judge = np.flatnonzero(~taken | handed)

    out_lat, out_lon = (np.where(place >= 0, v[place], np.nan) if m else v for v in (lat, lon))
    last = np.where(change >= 0, at[change], -1) if m else at
    accepted, rejected = known.copy(), np.zeros(m, np.int32)

    def as_taken(i: int):
        spot = (float(lat[place[i]]), float(lon[place[i]])) if place[i] >= 0 else (None, None)
        return (*spot, int(at[change[i]]) if change[i] >= 0 else None, 0)

    def entered(i: int):
        spot = [None if v[rows[i]] != v[rows[i]] else v[rows[i]] for v in entry[:3]]
        return (*(None if v is None else float(v) for v in spot[:2]), None if spot[2] is None else int(spot[2]), int(entry[3][rows[i]]))

    now, judged = None, -1
    i = int(judge[0]) if len(judge) else m
    while i < m:
        if fresh[i]:
            now = entered(i)
        elif judged != i - 1:
            now = as_taken(i - 1)
        now, accepted[i] = _judge(now, (int(at[i]), float(lat[i]), float(lon[i]), speed[i], ground[i]), bypass_us)
        out_lat[i], out_lon[i] = (math.nan, math.nan) if now[0] is None else now[:2]
        last[i], rejected[i], judged = -1 if now[2] is None else now[2], now[3], i
        if now == as_taken(i):  # go on at the next report that would not be taken
            following = int(np.searchsorted(judge, i + 1))
            i = int(judge[following]) if following < len(judge) else m
        else:
            i += 1

    # Rows that report nothing keep the state of the report before them in their session, or the one handed in.
    counts = np.zeros(n, np.int64)
    counts[rows] = 1
    newest = np.cumsum(counts) - 1
    own = (newest >= 0) & (of[newest] == session) if m else np.zeros(n, bool)

    def spread(values, first):
        return np.where(own, values[newest], first) if m else first

    flags = np.zeros(n, bool)
    flags[rows] = accepted
    return (spread(out_lat, entry[0]), spread(out_lon, entry[1]), spread(last, np.where(np.isnan(entry[2]), -1, entry[2]).astype(np.int64)),
            flags, spread(rejected, entry[3]).astype(np.int32))


def plausible_step(columns, state, bypass_us: int):
    """One batch of the position filter (``plausible_sessions``) that is entered with the state its last row was left with.

    State: session, latitude, longitude, time of last change (microseconds), rejections.
    """
    n, session = len(columns["_t"]), columns["_session"]
    if not n:
        return {"track_lat": np.zeros(0), "track_lon": np.zeros(0), "position_us": [], "accepted": np.zeros(0, bool), "rejections": np.zeros(0, np.int32)}, state
    handed, goes_on = _state_in(state, session[0]), session == session[0]
    entry = [*(np.where(goes_on, np.nan if v is None else v, np.nan) for v in handed[:3]), np.where(goes_on, handed[3], 0)]
    track_lat, track_lon, times, flags, rejections = plausible_sessions(columns, entry, bypass_us)
    updated = times.astype(object)
    updated[times < 0] = None
    outputs = {"track_lat": track_lat, "track_lon": track_lon, "position_us": updated.tolist(), "accepted": flags, "rejections": rejections}
    spot = (float(track_lat[-1]), float(track_lon[-1])) if track_lat[-1] == track_lat[-1] else (None, None)
    return outputs, (int(session[-1]), *spot, outputs["position_us"][-1], int(rejections[-1]))


def plausible_steps(columns, starts, state, bypass_us: int):
    """``plausible_step`` over a batch of many groups: the sessions of all groups are numbered through, as each begins without a position."""
    session = columns["_session"]
    fresh = np.zeros(len(session), bool)
    fresh[1:] = session[1:] != session[:-1]
    fresh[starts] = True
    numbers = np.cumsum(fresh)
    if state is not None:
        state = (int(numbers[0]), *state[1:]) if int(state[0]) == int(session[0]) else None
    outputs, end = plausible_step({**columns, "_session": numbers}, state, bypass_us)
    return outputs, (int(session[-1]), *end[1:])


#: Reports at the start of a slice that its summary tells one by one.
HEAD = 16


def plausible_transfer(columns, bypass_us: int):
    """What a slice makes of the state it is entered with: its end if a new session settles it; otherwise its first
    reports and, for the state right after each of them was taken, the end. Different beginnings mostly meet after a few
    reports, so few runs over the slice are needed."""
    session = columns["_session"]
    outputs, end = plausible_step(columns, None, bypass_us)

    def numbers(state):
        return [math.nan if v is None else float(v) for v in state]

    if session[0] != session[-1]:
        return [], numbers(end)
    rows = np.flatnonzero(columns["_surface"].astype(bool) | ~np.isnan(columns["_lat"]))
    runs, ends = [(0, outputs, end)], [end]
    for i in rows[:HEAD].tolist():
        after = (float(columns["_lat"][i]), float(columns["_lon"][i]), int(columns["_t"][i]), 0)
        met = next((e for first, o, e in runs if tuple(o[c][i - first] for c in ("track_lat", "track_lon", "position_us", "rejections")) == after), None)
        if met is None and after[0] == after[0]:
            outputs, met = plausible_step({c: v[i + 1:] for c, v in columns.items()}, (int(session[0]), *after), bypass_us)
            runs.append((i + 1, outputs, met))
        ends.append(met or end)
    told = [float(session[0]), float(len(rows) <= HEAD)]
    for c in ("_t", "_lat", "_lon", "_speed", "_surface"):
        told += columns[c][rows[:HEAD]].astype(float).tolist()
    return told, [x for e in ends for x in numbers(e)]


def plausible_through(lists, state, bypass_us: int):
    """End of a slice summed up by ``plausible_transfer`` that is entered with ``state``."""
    told, ends = lists

    def end(i: int):
        return (int(ends[5 * i]), *_state_in(ends[5 * i:5 * i + 5], int(ends[5 * i])))

    if not told or state is None or int(state[0]) != int(told[0]):
        return end(0)
    n = (len(told) - 2) // 5
    now = _state_in(state, int(told[0]))
    for i in range(n):
        t, lat, lon, speed, surface = (told[2 + c * n + i] for c in range(5))
        now, taken = _judge(now, (int(t), lat, lon, speed, bool(surface)), bypass_us)
        if taken and now[2] == int(t) and now[3] == 0:
            return end(i + 1)
    return (int(told[0]), *now) if told[1] else UNKNOWN


PLAUSIBLE_OUTPUT = "track_lat double, track_lon double, position_us long, accepted boolean, rejections int"
PLAUSIBLE_STATE = "session long, lat double, lon double, position_us long, rejections int"


def plausible_track(df: DataFrame, key, ts: str, order=None, lat: str = "lat", lon: str = "lon",
                    speed: str | None = None, surface: str | None = None, session: str | None = None,
                    timeout: str = "60 seconds") -> DataFrame:
    """Track position after each report, with implausible jumps left out.

    A report is taken if the track has no position, if the last one is older than half the
    time-out, or if it lies within (dt + 1 s) x speed of the last accepted one. ``speed`` is
    the air speed known at the row (900 kt if null). The fifth rejection in a row clears the
    position. ``surface`` rows are taken as they are. ``session`` separates tracks of a key.
    """
    bypass_us = interval_micros(df.sparkSession, timeout) // 2
    source = df.withColumns({
        "_t": micros(ts),
        "_lat": F.col(lat).cast("double"),
        "_lon": F.col(lon).cast("double"),
        "_speed": F.col(speed).cast("double") if speed else F.lit(None).cast("double"),
        "_surface": F.coalesce(F.col(surface), F.lit(False)) if surface else F.lit(False),
        "_session": F.col(session).cast("long") if session else F.lit(1).cast("long"),
    })

    def step(columns, state):
        return plausible_step(columns, state, bypass_us)

    kernel = Kernel(("_t", "_lat", "_lon", "_speed", "_surface", "_session"), PLAUSIBLE_STATE, PLAUSIBLE_OUTPUT, step,
                    lambda columns: plausible_transfer(columns, bypass_us), lambda lists, state: plausible_through(lists, state, bypass_us), "double",
                    lambda columns, starts, state: plausible_steps(columns, starts, state, bypass_us))
    return fold(source, key, order or [ts], kernel).drop(*kernel.inputs)
