"""Incremental ingest over Structured Streaming."""

from .dedup import ProgressListener, append_new_chunks, distinct_chunks, stream_chunks, with_progress  # noqa: F401
