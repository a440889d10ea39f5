"""Files to xorbs, shard tables and file hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as c
from ..operators.chunking import chunk_files
from ..operators.dedup import chunk_stats, first_occurrences, mark_duplicates
from ..operators.merkle import file_hashes
from ..operators.packing import assign_xorbs, build_xorbs, file_segments, xorb_chunks
from ..shared import keep


@dataclass
class Ingested:
    """The tables of an ingest. Write ``xorbs`` before what refers to them (see
    :class:`Store`)."""

    chunks: DataFrame
    unique: DataFrame
    xorbs: DataFrame
    xorb_chunks: DataFrame
    segments: DataFrame
    hashes: DataFrame


def ingest(
    files: DataFrame,
    id_col: str = "file_id",
    data_col: str = "content",
    codec: str = "lz4",
    algorithm: str = "gearhash",
    cap: int = c.XORB_CAP,
    known: DataFrame | None = None,
    dedup: bool = True,
    once: bool = True,
    chunks: DataFrame | None = None,
    **chunking,
) -> Ingested:
    """Chunk, hash, dedup, pack and serialise files.

    A chunk is stored by the file that has it first, in that file's xorbs.
    ``chunks`` brings the chunks of ``files`` (of files too large for a cell, see
    :func:`chunk_large_files`). ``known`` (chunk_hash, xorb_hash, xorb_chunk, size) lists chunks that are
    stored already. ``dedup=False`` packs every occurrence, file by file. An
    empty or null content has no chunks, the zero hash and no segments.

    Files are chunked and xorbs built once: both are kept in the shared folder,
    and all tables follow from their metadata columns. ``once=False`` keeps
    nothing; each table that is read then repeats what it rests on.
    """
    kept = keep if once else lambda df, _: df
    made = chunks if chunks is not None else chunk_files(files, id_col, data_col, algorithm, **chunking)
    chunks = kept(made, "chunks")
    meta = chunks.select("file_id", "chunk_index", "chunk_hash", "size")
    unique = first_occurrences(meta).select("chunk_hash", "size", "copies", F.col("first.file_id").alias("file_id"), F.col("first.chunk_index").alias("chunk_index"))
    if known is not None:
        unique = unique.join(known.select("chunk_hash"), "chunk_hash", "left_anti")
    stored = unique.select("file_id", "chunk_index", "chunk_hash", "size") if dedup else meta
    xorbs = kept(build_xorbs(assign_xorbs(stored, cap), chunks, codec), "xorbs")
    index = xorb_chunks(xorbs)
    places = index.groupBy("chunk_hash").agg(F.min(F.struct("xorb_hash", "chunk_index")).alias("at"), F.min("size").alias("size"))
    places = places.select("chunk_hash", F.col("at.xorb_hash").alias("xorb_hash"), F.col("at.chunk_index").alias("xorb_chunk"), "size")
    if known is not None:
        places = places.unionByName(known.select("chunk_hash", "xorb_hash", "xorb_chunk", "size"))
    hashes = file_hashes(meta, files.select(F.col(id_col).alias("file_id")))
    return Ingested(chunks, unique, xorbs, index, file_segments(meta, places), hashes)


def convert_stats(files: DataFrame, done: Ingested) -> DataFrame:
    """(file_id, file_size, chunk_count, unique_chunk_count, dedup_savings,
    xorb_count, xorb_bytes, compression_pct) of each converted file."""
    marked = mark_duplicates(done.chunks.select("file_id", "chunk_index", "chunk_hash", "size"))
    stats = chunk_stats(marked, "file_id")
    xorbs = done.xorbs.groupBy("file_id").agg(F.count(F.lit(1)).alias("xorb_count"), F.sum("serialized_size").alias("xorb_bytes"))
    zero = F.lit(0).cast("bigint")
    size, stored = F.coalesce("raw_bytes", zero), F.coalesce("xorb_bytes", zero)
    return files.select("file_id").distinct().join(stats, "file_id", "left").join(xorbs, "file_id", "left").select(
        "file_id",
        size.alias("file_size"),
        F.coalesce("chunks", zero).alias("chunk_count"),
        F.coalesce("unique_chunks", zero).alias("unique_chunk_count"),
        F.coalesce("dedup_savings", zero).alias("dedup_savings"),
        F.coalesce("xorb_count", zero).alias("xorb_count"),
        stored.alias("xorb_bytes"),
        F.when(size > 0, (1 - stored / size) * 100).otherwise(F.lit(0.0)).alias("compression_pct"),
    )
