"""Keyed state on a stream: a small step per key and micro-batch, a timer per key for expiry.

All of these run ``transformWithStateInPandas`` and need the RocksDB state store, which
``use_state_store`` selects. Each stream needs a watermark on its time column first.
Rows of a micro-batch are taken in event-time order per key, so with in-order input the
output equals the batch operator's.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from skytally.operators.folds import interval_micros
from skytally.operators.ordered import as_list

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Select the state store these operators need, unless the session already names one of its kind."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows of a key in their order, missing values last; equal ones stay as they came."""
    parts = list(rows)
    batch = parts[0].reset_index(drop=True) if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    if len(batch) < 2:
        return batch
    if any(batch[c].dtype.kind not in "iufM" for c in order):
        return batch.sort_values(order, kind="stable", ignore_index=True)
    places = np.lexsort([batch[c].to_numpy() for c in reversed(order)])
    return batch if (np.diff(places) == 1).all() else batch.take(places).reset_index(drop=True)


class KeyedStep(StatefulProcessor):
    """Runs ``step(rows, state) -> (output rows, state)`` per key. After ``timeout_ms`` the key is forgotten, or
    ``on_expiry(key, state) -> (output rows, state to keep)`` decides."""

    def __init__(self, step: Callable, state: StructType, order: list[str], ts: str, timeout_ms: int | None,
                 on_expiry: Callable | None):
        self.step, self.state_schema, self.order, self.ts = step, state, order, ts
        self.timeout_ms, self.on_expiry = timeout_ms, on_expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, self.order)
        before = self.state.get()  # None for a new key: every call is a message to the JVM and back
        out, after = self.step(batch, None if before is None else tuple(before))
        self.state.update(after)
        if self.timeout_ms is not None:
            if before is not None:  # a key without state has no timer
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            newest = int(batch[self.ts].iloc[-1].value // 1_000_000)
            self.handle.registerTimer(newest + self.timeout_ms + 1)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last = tuple(self.state.get())
            if self.on_expiry is None:
                self.state.clear()
            else:
                out, kept = self.on_expiry(key, last)
                self.state.update(kept)
                yield out

    def close(self) -> None:
        pass


def keyed_stream(df: DataFrame, key, ts: str, step: Callable, state: str, output: str | StructType, order=None,
                 timeout=None, on_expiry: Callable | None = None, mode: str = "Append") -> DataFrame:
    """Apply a step with one state row per key; ``timeout`` of event time drops the state, or leaves what ``on_expiry`` keeps."""
    timeout_ms = None if timeout is None else interval_micros(df.sparkSession, timeout) // 1000
    schema = _parse_datatype_string(output) if isinstance(output, str) else output
    processor = KeyedStep(step, _parse_datatype_string(state), order or [ts], ts, timeout_ms, on_expiry)
    return df.groupBy(*as_list(key)).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode,
        timeMode="None" if timeout is None else "EventTime")


def _us(values: pd.Series) -> list[int]:
    return (values.astype("int64") if values.dtype.kind != "M" else values.astype("datetime64[us]").astype("int64")).tolist()


def dedup_stream(df: DataFrame, keys, ts: str, window="50 milliseconds", order=None) -> DataFrame:
    """Streaming ``dedup_within``: a repeat refreshes the stamp, so a chain of them is all dropped."""
    limit = interval_micros(df.sparkSession, window)
    us = _us

    def step(rows, state):
        last, keep = (None if state is None else state[0]), []
        for t in us(rows[ts]):
            keep.append(last is None or t - last > limit)
            last = t
        return rows[keep], (last,)

    # State older than the window decides nothing; it is dropped after a second at least.
    timeout = max(limit / 1e6, 1.0)
    return keyed_stream(df, keys, ts, step, "last_us long", df.schema, order, timeout)


def gate_stream(df: DataFrame, key, ts: str, n: int = 10, timeout="30 seconds", order=None,
                trusted: str | None = None) -> DataFrame:
    """Streaming ``confidence_gate``; ``trusted`` names a boolean column of sightings that count n-fold."""
    limit = interval_micros(df.sparkSession, timeout)
    us = _us

    def step(rows, state):
        seen, last = (0, None) if state is None else state
        keep = []
        marks = rows[trusted].tolist() if trusted else [False] * len(rows)
        for t, mark in zip(us(rows[ts]), marks):
            if last is not None and t - last > limit:
                seen = 0
            seen, last = seen + (n if mark else 1), t
            keep.append(seen >= n)
        return rows[keep], (seen, last)

    return keyed_stream(df, key, ts, step, "seen long, last_us long", df.schema, order, timeout)


def rate_limit_stream(df: DataFrame, key, ts: str, every="1 second", order=None) -> DataFrame:
    """Streaming ``rate_limit``: emits at most one row per key and interval since the last emitted one."""
    limit = interval_micros(df.sparkSession, every)
    us = _us

    def step(rows, state):
        last, keep = (None if state is None else state[0]), []
        for t in us(rows[ts]):
            emit = last is None or t - last >= limit
            keep.append(emit)
            if emit:
                last = t
        return rows[keep], (last,)

    return keyed_stream(df, key, ts, step, "last_us long", df.schema, order, max(limit / 1e6, 1.0))


def changed_only_stream(df: DataFrame, key, ts: str, order=None, ignore=(), timeout=None) -> DataFrame:
    """Streaming ``changed_only``: a row is emitted if its content hash differs from the last one's.

    With ``timeout`` a key silent for so long is forgotten, and its next row emitted; without, the state
    grows with the number of keys.
    """
    skip = {*as_list(key), *(order or [ts]), *ignore}
    content = [c for c in df.columns if c not in skip]
    hashed = df.withColumn("content_hash", F.xxhash64(F.struct(*content)))

    def step(rows, state):
        last, keep = (None if state is None else state[0]), []
        for value in rows["content_hash"].tolist():
            keep.append(value != last)
            last = value
        return rows[keep].drop(columns="content_hash"), (last,)

    return keyed_stream(hashed, key, ts, step, "content long", df.schema, order, timeout)


def lifecycle_stream(df: DataFrame, key: str, ts: str, timeout="60 seconds", order=None) -> DataFrame:
    """Streaming life cycle: ``added`` / ``updated`` per row, ``expired`` when the timer fires. A key that expired keeps the number
    of its last session, so the next one counts on."""
    limit = interval_micros(df.sparkSession, timeout)
    key_type = df.schema[key].dataType.simpleString()
    us = _us

    def step(rows, state):
        last, session = (None, 0) if state is None else state
        events = []
        for k, t in zip(rows[key].tolist(), us(rows[ts])):
            if last is not None and t - last > limit:
                events.append((k, session, "expired", last + limit))
                last = None
            if last is None:
                session += 1
                events.append((k, session, "added", t))
            else:
                events.append((k, session, "updated", t))
            last = t
        return pd.DataFrame(events, columns=[key, "session", "event", "at_us"]), (last, session)

    def on_expiry(group, state):
        rows = [] if state[0] is None else [(group[0], state[1], "expired", state[0] + limit)]
        return pd.DataFrame(rows, columns=[key, "session", "event", "at_us"]), (None, state[1])

    output = f"`{key}` {key_type}, session long, event string, at_us long"
    return keyed_stream(df, key, ts, step, "last_us long, session long", output, order, timeout, on_expiry)
