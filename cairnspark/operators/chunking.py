"""Files to content-defined, hashed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as c
from ..kernels.blake3 import keyed
from ..kernels.gear import cut, table_of

#: Bytes of chunks hashed and handed on together.
_BATCH_BYTES = 8 << 20


def chunk_files(
    files: DataFrame,
    id_col: str = "file_id",
    data_col: str = "content",
    algorithm: str = "gearhash",
    least: int = c.MIN_CHUNK,
    most: int = c.MAX_CHUNK,
    bits: int = c.CUT_BITS,
    table: str | None = None,
    with_data: bool = True,
) -> DataFrame:
    """One row a chunk: file_id, chunk_index, start, end, size, chunk_hash and,
    unless switched off, data.

    Narrow: chunks and hashes are made where the file is read, and only columns
    that are asked for leave Python. Text is taken as UTF-8. Null and empty
    contents have no chunks; equal ids are not told apart.
    """
    words = table_of(table)
    id_type = files.schema[id_col].dataType.simpleString()
    fields = f"file_id {id_type}, chunk_index int, start bigint, end bigint, size bigint, chunk_hash binary"
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()] + [pa.binary()] * with_data
    names = ["file_id", "chunk_index", "start", "end", "size", "chunk_hash"] + ["data"] * with_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, data, held = batch.column(0), [], [], 0

            def close() -> pa.RecordBatch:
                own = ids.take(pa.array([r[0] for r in rows], pa.int64()))
                hashes = keyed(c.DATA_KEY, data)
                cols = [[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[3] - r[2] for r in rows], hashes] + [data] * with_data
                return pa.RecordBatch.from_arrays([own, *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], names)

            for i, content in enumerate(batch.column(1)):
                content = content.as_py()
                if not content:
                    continue
                start = 0
                for k, end in enumerate(cut(content, algorithm, least, most, bits, words)):
                    rows.append((i, k, start, end))
                    data.append(content[start:end])
                    held, start = held + end - start, end
                    if held >= _BATCH_BYTES:
                        yield close()
                        rows, data, held = [], [], 0
            if rows:
                yield close()

    picked = files.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("content"))
    return picked.mapInArrow(run, fields + ", data binary" * with_data)


def pack_files(rows: DataFrame, group_cols: list[str], order_col: str, data_col: str) -> DataFrame:
    """Small rows joined to files: one file a group, rows in ``order_col`` order
    (ties by content), null data as empty. Group so that a file fits a cell."""
    part = F.struct(F.col(order_col).alias("o"), F.coalesce(F.col(data_col).cast("binary"), F.lit(b"")).alias("d"))
    joined = rows.groupBy(*group_cols).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return joined.select(*group_cols, F.expr("unhex(array_join(transform(parts, p -> hex(p.d)), ''))").alias("content"))
