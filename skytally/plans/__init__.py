"""Whole pipelines: derived inputs, the current picture, and the query catalogue."""
