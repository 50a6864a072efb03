"""Structured Streaming entry points (the reference has no streaming; see README)."""

from riskframe.streaming.ingest import ingest_stream  # noqa: F401
