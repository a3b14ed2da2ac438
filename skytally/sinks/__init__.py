"""Exports: text lines, JSON lines, wire bytes, history tables."""

from skytally.sinks.basestation import basestation_flags, basestation_gate, basestation_rows, to_basestation
from skytally.sinks.history import write_history
from skytally.sinks.ndjson import to_ndjson
from skytally.sinks.wire import to_wire

__all__ = ["basestation_flags", "basestation_gate", "basestation_rows", "to_basestation", "to_ndjson", "to_wire",
           "write_history"]
