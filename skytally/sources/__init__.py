"""Readers of frames, captures and the registry."""

from skytally.sources.captures import read_capture_stream, read_captures, write_captures
from skytally.sources.readers import read_frame_stream, read_frames, union_sources
from skytally.sources.registry import check_registry, latest_release, read_registry

__all__ = ["check_registry", "latest_release", "read_capture_stream", "read_captures", "read_frame_stream", "read_frames", "read_registry",
           "union_sources", "write_captures"]
