"""Metadata shards: built from and taken apart into DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .. import constants as c
from ..kernels.codec import FormatError, ShardFold, ShardLayout, shard_layout


def build_shards(segments: DataFrame, chunks: DataFrame, by: str = "shard", key: bytes = c.ZERO, created: int = 0, expires: int = 0) -> DataFrame:
    """(by, payload): one serialised shard a group.

    ``segments``: by, file_hash, segment_index, xorb_hash,
    unpacked_segment_size, chunk_index_start, chunk_index_end, range_hash
    (null: none). ``chunks``: by, xorb_hash, chunk_index, chunk_hash,
    byte_range_start, size, serialized_size (of the xorb). Files and xorbs
    stand by hash, so equal contents give equal bytes. ``key`` only goes into
    the footer: key the hashes first. A shard is one cell, so a group is what
    fits one; sizes beyond 32 bits fail. Rows are sorted by Spark and folded as
    they stream by: what is held is a batch and the shard's own bytes.
    """
    kind = segments.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fold = None, None

        def ended() -> pa.RecordBatch:
            payload = fold.close()
            cell = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(payload)], np.int32)), pa.py_buffer(payload)])
            return pa.RecordBatch.from_arrays([pa.array([own], own_kind), cell], [by, "payload"])

        for batch in batches:
            own_kind = batch.schema.field(0).type
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if fold is not None and keys[s][0] != own:
                    yield ended()
                    fold = None
                own, fold = keys[s][0], fold or ShardFold(key, created, expires)
                _, _, outer, inner, *sizes, ranges = (batch.column(i).slice(s, e - s) for i in range(8))
                rows = (_hashes(outer), _hashes(inner), *map(_sizes, sizes))
                if keys[s][1] == 0:
                    fold.add_segments(*rows, ranges.to_pylist())
                else:
                    fold.add_chunks(*rows)
        if fold is not None:
            yield ended()

    def section(rows: DataFrame, number: int, outer: str, index: str, *columns: str | Column) -> DataFrame:
        inner, *sizes, ranges = columns
        words = [F.col(x).cast("bigint").alias(f"w{k}") for k, x in enumerate(sizes)]
        return rows.select(F.col(by).cast(kind).alias("own"), F.lit(number).alias("section"), F.col(outer).alias("h"), F.col(inner).alias("inner"), *words, ranges.cast("binary").alias("r"), F.col(index).cast("bigint").alias("i"))

    left = section(segments, 0, "file_hash", "segment_index", "xorb_hash", "unpacked_segment_size", "chunk_index_start", "chunk_index_end", F.col("range_hash"))
    right = section(chunks, 1, "xorb_hash", "chunk_index", "chunk_hash", "byte_range_start", "size", "serialized_size", F.lit(None))
    rows = left.union(right).repartition("own").sortWithinPartitions("own", "section", "h", "i").drop("i")
    return rows.mapInArrow(run, f"`{by}` {kind}, payload binary")


def _hashes(column: pa.Array) -> np.ndarray:
    """Hashes as rows of 32 bytes."""
    if column.null_count:
        raise FormatError("a hash is missing")
    return np.frombuffer(b"".join(x[:32].ljust(32, b"\0") for x in column.to_pylist()), np.uint8).reshape(-1, 32)


def _sizes(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise FormatError("a size is missing")
    return column.to_numpy(zero_copy_only=False)


def _binary(rows: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Rows of 32 bytes as binary values, null where not ``known``."""
    got = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())
    return got if known is None else pc.if_else(pa.array(known), got, pa.scalar(None, pa.binary()))


def _view(cell: pa.Scalar) -> memoryview:
    """A cell's bytes, not copied."""
    return memoryview(cell.as_buffer()).cast("B")


def _exploded(shards: DataFrame, id_col: str, payload_col: str, strict: bool, fields: list[tuple[str, str, pa.DataType]], rows_of: Callable[[ShardLayout], Iterator[list]]) -> DataFrame:
    """Rows of each shard, a part at a time: what is held is its bytes."""
    kind = shards.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column(1)[i]
                if not cell.is_valid:
                    continue
                for cols in rows_of(shard_layout(_view(cell), strict)):
                    own = batch.column(0).take(pa.array(np.full(len(cols[0]), i)))
                    cols = [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)).cast(f[2]) for x, f in zip(cols, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([own, *cols], [id_col, *[f[0] for f in fields]])

    return shards.select(id_col, F.col(payload_col).cast("binary").alias("payload")).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in fields))


def shard_segments(shards: DataFrame, id_col: str = "shard", payload_col: str = "payload", strict: bool = True) -> DataFrame:
    """The file section: one row a segment of a file (id, file_hash,
    segment_index, xorb_hash, unpacked_segment_size, chunk_index_start,
    chunk_index_end, range_hash)."""
    fields = [("file_hash", "binary", pa.binary()), ("segment_index", "int", pa.int32()), ("xorb_hash", "binary", pa.binary()), ("unpacked_segment_size", "bigint", pa.int64()), ("chunk_index_start", "int", pa.int32()), ("chunk_index_end", "int", pa.int32()), ("range_hash", "binary", pa.binary())]

    def rows(s: ShardLayout) -> Iterator[list]:
        for own, index, x, size, start, end, ranged, r in s.segments():
            yield [_binary(own), index, _binary(x), size, start, end, _binary(r, ranged)]

    return _exploded(shards, id_col, payload_col, strict, fields, rows)


def shard_chunks(shards: DataFrame, id_col: str = "shard", payload_col: str = "payload", strict: bool = True) -> DataFrame:
    """The xorb section: one row a chunk (id, position in the shard, xorb_hash,
    chunk_index, chunk_hash, byte_range_start, size). ``strict=False`` accepts
    a wrong tag and ends quietly where a section is cut short."""
    fields = [("position", "bigint", pa.int64()), ("xorb_hash", "binary", pa.binary()), ("chunk_index", "int", pa.int32()), ("chunk_hash", "binary", pa.binary()), ("byte_range_start", "bigint", pa.int64()), ("size", "bigint", pa.int64()), ("serialized_size", "bigint", pa.int64())]

    def rows(s: ShardLayout) -> Iterator[list]:
        for at, x, index, h, start, size, stored in s.chunks():
            yield [at, _binary(x), index, _binary(h), start, size, stored]

    return _exploded(shards, id_col, payload_col, strict, fields, rows)


def shard_footer(payload: Column, strict: bool = True) -> Column:
    """struct<is_keyed, chunk_hash_key, created, expires, file_info_offset,
    cas_info_offset, footer_offset>; an unset key or time is null."""

    @arrow_udf("struct<key: binary, created: bigint, expires: bigint, file_info_offset: bigint, cas_info_offset: bigint, footer_offset: bigint>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for p in rows:
            s = shard_layout(_view(p), strict).footer if p.is_valid else None
            out.append(s and {"key": s.key, "created": s.created, "expires": s.expires, "file_info_offset": s.file_offset, "cas_info_offset": s.xorb_offset, "footer_offset": s.footer_offset})
        return pa.array(out, pa.struct([("key", pa.binary()), *[(n, pa.int64()) for n in ("created", "expires", "file_info_offset", "cas_info_offset", "footer_offset")]]))

    f = run(payload.cast("binary"))
    keyed = f["key"] != F.lit(c.ZERO)
    return F.struct(
        keyed.alias("is_keyed"),
        F.when(keyed, f["key"]).alias("chunk_hash_key"),
        F.timestamp_seconds(F.nullif(f["created"], F.lit(0))).alias("created"),
        F.timestamp_seconds(F.nullif(f["expires"], F.lit(0))).alias("expires"),
        f["file_info_offset"].alias("file_info_offset"),
        f["cas_info_offset"].alias("cas_info_offset"),
        f["footer_offset"].alias("footer_offset"),
    )
