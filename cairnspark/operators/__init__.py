"""Operators over files, chunks, xorbs and shards, all as DataFrames."""

from .catalog import catalog_lookup, ensure_namespace, file_list, find_file, latest_entries, put_if_absent  # noqa: F401
from .chunking import chunk_files, pack_files  # noqa: F401
from .dedup import chunk_stats, first_occurrences, known_chunks, mark_duplicates, new_chunks  # noqa: F401
from .lookup import expand_segments, fetch_plan, keyed_index, lookup_chunks, match_fetch_ranges  # noqa: F401
from .merkle import file_hashes, merkle_groups, range_hashes, tree_roots  # noqa: F401
from .packing import assign_xorbs, build_xorbs, file_segments, raw_offsets, xorb_chunks  # noqa: F401
from .reconstruct import reconstruct, reconstruct_range, reconstruct_stream, verify_chunks  # noqa: F401
from .shards import build_shards, shard_chunks, shard_footer, shard_segments  # noqa: F401
from .xorbs import extract_range, read_chunk, read_xorb  # noqa: F401
