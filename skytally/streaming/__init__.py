"""Structured Streaming forms of the stateful operators."""

from skytally.streaming.keyed import (
    changed_only_stream,
    dedup_stream,
    gate_stream,
    keyed_stream,
    lifecycle_stream,
    rate_limit_stream,
)
from skytally.streaming.lines import text_line_stream
from skytally.streaming.output import (
    batch_table,
    fan_out,
    late_counts,
    late_rows,
    newest_registry,
    session_counts,
    split_late,
    trailing_outline,
    with_event_time,
    with_registry,
)
from skytally.streaming.tracking import state_stream, track_rows, track_stream

__all__ = ["batch_table", "changed_only_stream", "dedup_stream", "fan_out", "gate_stream", "keyed_stream", "late_counts", "late_rows",
           "lifecycle_stream", "newest_registry", "rate_limit_stream", "session_counts", "split_late", "state_stream", "text_line_stream", "track_rows",
           "track_stream", "trailing_outline", "with_event_time", "with_registry"]
