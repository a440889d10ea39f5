"""Whole jobs: ingest, convert, and the store they commit to."""

from .ingest import Ingested, convert_stats, ingest  # noqa: F401
from .store import Store  # noqa: F401
