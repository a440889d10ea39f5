"""Readers and writers of the binary and JSON formats."""

from .blocks import chunk_large_files, read_xorb_ranges  # noqa: F401
from .files import read_files, read_gear_table  # noqa: F401
from .formats import ShardSource, XorbSource, read_shards, read_xorbs, register_formats, write_blobs  # noqa: F401
from .plans_json import fetch_infos, parse_listing, parse_reconstruction, terms_of, to_reconstruction_json  # noqa: F401
