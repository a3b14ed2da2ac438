"""Text lines from a stream: formatted row by row before the keyed step, which only holds what was sent for a track."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from skytally.operators.folds import interval_micros
from skytally.sinks.basestation import NEEDS_SQUITTER, SQUITTER_KINDS, TRANSMISSION, formatted_lines, sent_lines
from skytally.streaming.keyed import keyed_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKS = "is_first boolean, may_send boolean, announces boolean"


def gate_marks(t: np.ndarray, squitter: np.ndarray, reply: np.ndarray, named: np.ndarray, limit: int, state) -> tuple[dict, tuple]:
    """The gate's marks of one key's rows in order, and the state after them: last time, squitter heard, callsign told."""
    last, heard, told = (None, False, False) if state is None else state
    at = np.arange(len(t))
    fresh = np.diff(t, prepend=t[0] if last is None else last) > limit
    fresh[0] |= last is None
    start = np.maximum.accumulate(np.where(fresh | (at == 0), at, 0))
    goes_on = np.cumsum(fresh) == 0

    def so_far(marks):
        total = np.cumsum(marks)
        return total - total[start] + marks[start]

    any_heard = (so_far(squitter) > 0) | (goes_on & heard)
    told_by_now = so_far(named) + (goes_on & told)
    marks = {"is_first": fresh, "may_send": ~reply | any_heard, "announces": named & (told_by_now == 1)}
    return marks, (int(t[-1]), bool(any_heard[-1]), bool(told_by_now[-1]))


def text_line_stream(df: DataFrame, key: str = "icao", ts: str = "ts", timeout="60 seconds", order=None) -> DataFrame:
    """Streaming ``to_basestation``: ``icao``, the order columns, ``part`` and ``line``.

    ``df`` has the columns that ``to_basestation`` takes but the session, and a watermark on ``ts``. A track ends after a silence
    of ``timeout``; what was heard and sent for it is then forgotten.
    """
    order = order or [ts]
    limit = interval_micros(df.sparkSession, timeout)
    squitters, replies = list(SQUITTER_KINDS), [k for k, n in TRANSMISSION.items() if n in NEEDS_SQUITTER]
    kept = list(dict.fromkeys([key, "icao", ts, *order]))
    rows = formatted_lines(df, ts).select(
        *kept, "air_line", "msg_line", "id_line", F.coalesce(F.col("msg_type").isin(squitters), F.lit(False)).alias("x_squitter"),
        F.coalesce(F.col("msg_type").isin(replies), F.lit(False)).alias("x_reply"),
        F.coalesce((F.col("msg_type") == "identification") & F.col("callsign").isNotNull(), F.lit(False)).alias("x_named"))
    output = StructType([*rows.drop("x_squitter", "x_reply", "x_named").schema.fields, *_parse_datatype_string(MARKS).fields])

    def step(batch: pd.DataFrame, state):
        t = batch[ts].astype("datetime64[us]").astype("int64").to_numpy()
        marks, after = gate_marks(t, *(batch[c].to_numpy(bool) for c in ("x_squitter", "x_reply", "x_named")), limit, state)
        return batch.drop(columns=["x_squitter", "x_reply", "x_named"]).assign(**marks), after

    gated = keyed_stream(rows, key, ts, step, "last_us long, heard boolean, told boolean", output, order, timeout)
    return sent_lines(gated, order)
