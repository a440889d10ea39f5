"""Files from their segments: whole, a byte range, or as ordered rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import data_hash
from .lookup import expand_segments
from .xorbs import read_xorb


def _pieces(segments: DataFrame, chunks: DataFrame, verify: bool = True) -> DataFrame:
    """(file_id, segment_index, chunk_index, xorb_hash, chunk_hash, size,
    offset): where in the file each chunk stands, and the hash that it has to
    have (null: unchecked). The window is per file, over the index alone."""
    own = F.col("chunk_hash") if verify else F.lit(None).cast("binary").alias("chunk_hash")
    rows = expand_segments(segments, chunks.select("xorb_hash", "chunk_index", own, "size"))
    w = Window.partitionBy("file_id").orderBy("segment_index", "chunk_index")
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))


def _with_data(pieces: DataFrame, xorbs: DataFrame, strict: bool = True) -> DataFrame:
    """The pieces with their bytes. Xorbs are first cut down to those needed; of
    each, the chunks that some piece refers to are decoded, once, and held
    against their hashes. (A xorb bounds what is gathered of it.)"""
    needed = pieces.groupBy("xorb_hash").agg(F.collect_set(F.struct("chunk_index", "chunk_hash")).alias("wanted"))
    stored = read_xorb(xorbs.select("xorb_hash", "payload").join(needed, "xorb_hash"), strict=strict, wanted="wanted")
    return pieces.join(stored.select("xorb_hash", "chunk_index", "data"), ["xorb_hash", "chunk_index"])


def _joined(rows: DataFrame, data: Column) -> DataFrame:
    """(file_id, content, fault): each file's parts in order of offset; a file
    is one cell here (see :func:`reconstruct_stream` for larger ones). A part
    that is not what its hash says leaves no content."""
    kind = rows.schema["file_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        parts = table.sort_by("offset").column("data").to_pylist()
        bad = None in parts
        content, fault = pa.array([None if bad else b"".join(parts)], pa.binary()), pa.array(["HashMismatch" if bad else None], pa.string())
        return pa.table({"file_id": table.column("file_id").slice(0, 1), "content": content, "fault": fault})

    return rows.select("file_id", "offset", data.alias("data")).groupBy("file_id").applyInArrow(run, f"file_id {kind}, content binary, fault string")


def _checked(got: DataFrame, wanted: DataFrame, strict: bool) -> DataFrame:
    """Every wanted file (file_id, wanted), with content or an error."""
    out = wanted.join(got, "file_id", "left").withColumn("content", F.when(F.col("wanted") == 0, F.coalesce("content", F.lit(b""))).otherwise(F.col("content")))
    error = F.coalesce("fault", F.when(F.coalesce(F.length("content"), F.lit(0)) != F.col("wanted"), F.lit("SizeMismatch")))
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    return out.select("file_id", "content", error.alias("error"))


def reconstruct(segments: DataFrame, chunks: DataFrame, xorbs: DataFrame, strict: bool = True, verify: bool = True) -> DataFrame:
    """(file_id, content, error) of every file in ``segments``; the size is
    always checked, and every chunk's hash unless ``verify`` is off. Not strict:
    files that come short carry SizeMismatch, those with a chunk of other bytes
    HashMismatch, and the others are whole."""
    wanted = segments.groupBy("file_id").agg(F.sum("unpacked_segment_size").alias("wanted"))
    got = _joined(_with_data(_pieces(segments, chunks, verify), xorbs, strict), F.col("data"))
    return _checked(got, wanted, strict)


def reconstruct_range(segments: DataFrame, chunks: DataFrame, xorbs: DataFrame, ranges: DataFrame, strict: bool = True, verify: bool = True) -> DataFrame:
    """(file_id, content, error): bytes [range_start, range_end) of files.

    ``ranges`` has one row a file. Only chunks that overlap the range are
    decoded (and checked, as in :func:`reconstruct`), and the first and last are
    clipped. An empty range is empty binary; one that ends past the file is a
    SizeMismatch.
    """
    lo, hi = F.col("range_start"), F.col("range_end")
    pieces = _pieces(segments, chunks, verify).join(ranges.select("file_id", "range_start", "range_end"), "file_id")
    pieces = pieces.filter((F.col("offset") < hi) & (F.col("offset") + F.col("size") > lo))
    skip = F.greatest(lo - F.col("offset"), F.lit(0))
    upto = F.least(hi - F.col("offset"), F.col("size"))
    rows = _with_data(pieces, xorbs, strict)
    data = F.substring(F.col("data"), (skip + 1).cast("int"), (upto - skip).cast("int"))
    wanted = ranges.select("file_id", F.greatest(hi - lo, F.lit(0)).alias("wanted"))
    return _checked(_joined(rows, data), wanted, strict)


def reconstruct_stream(segments: DataFrame, chunks: DataFrame, xorbs: DataFrame) -> DataFrame:
    """(file_id, offset, data): files as ordered rows, for files of any size.
    A file's rows are in one partition, sorted by offset. A chunk of other bytes
    than its hash says fails the job."""
    rows = _with_data(_pieces(segments, chunks), xorbs).select("file_id", "offset", "data")
    return rows.repartition("file_id").sortWithinPartitions("file_id", "offset")


def verify_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_hash, data) with ``ok``: whether the bytes still have the
    hash."""
    return chunks.withColumn("ok", data_hash(F.col("data")) == F.col("chunk_hash"))
