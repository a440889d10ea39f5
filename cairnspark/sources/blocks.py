"""Byte ranges of stored files: files too large for a cell, and parts of xorbs.

Ranges are read by the executors through pyarrow's file systems (local, S3, GCS,
HDFS with its library)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as c
from ..kernels.blake3 import keyed
from ..kernels.codec import frames
from ..kernels.gear import ALGORITHMS, cuts_of_candidates, gear_candidates, table_of, ultra_end

#: Bytes of a file that a task reads at a time.
BLOCK = 64 << 20


class _Files:
    """The file that was read last stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, start: int, size: int) -> bytes:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            at = f"file://{path.removeprefix('file:').removeprefix('//')}" if path.startswith("file:") else path
            fs, at = pafs.FileSystem.from_uri(at)
            self.path, self.file = path, fs.open_input_file(at)
        self.file.seek(start)
        return self.file.read(size)


def chunk_large_files(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    algorithm: str = "gearhash",
    least: int = c.MIN_CHUNK,
    most: int = c.MAX_CHUNK,
    bits: int = c.CUT_BITS,
    table: str | None = None,
    with_data: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """The chunks of all files under a path, as :func:`chunk_files` has them,
    of files of any size.

    The rolling hash at a byte depends on the 64 bytes up to it, so blocks are
    searched for possible cuts side by side, each with the 63 bytes before it;
    the choice among them is a fold over a file's few candidates, in order. The
    chunks are then read, and hashed, block by block. Ultracdc has no such
    window: there a file's cuts are found in one pass over it. Empty files have
    no chunks. Files must not change between the passes.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm is one of {sorted(ALGORITHMS)}")
    words, gear = table_of(table), algorithm == "gearhash"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select(F.col("path").alias("file_id"), F.col("length").alias("n")).filter("n > 0")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Files()
        for batch in batches:
            for name, n, at in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                lead = min(at, 63)
                data = np.frombuffer(held.read(name, at - lead, lead + min(block, n - at)), np.uint8)
                found = gear_candidates(data, words, bits)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([found[found > lead] + (at - lead)], pa.list_(pa.int64()))], ["file_id", "n", "at", "found"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            for name, n, found in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if name != own:
                    if own is not None:
                        yield _bounds(own, state.end())
                    own, state = name, cuts_of_candidates(n, least, most)
                if cuts := state.add(found):
                    yield _bounds(own, cuts)
        if own is not None:
            yield _bounds(own, state.end())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, normal = _Files(), min(max(c.NORMAL_CHUNK * least // c.MIN_CHUNK, least), most)
        for batch in batches:
            for name, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                at, k = 0, 0
                while at < n:
                    out = []
                    while at < n and len(out) < 1024:
                        end = at + ultra_end(np.frombuffer(held.read(name, at, min(most, n - at)), np.uint8), least, normal, most)
                        out.append((k, at, end))
                        at, k = end, k + 1
                    yield _bounds(name, out)

    def _bounds(name: str, cuts: list[tuple[int, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*cuts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(cuts)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["file_id", "chunk_index", "start", "end"])

    bounds_schema = "file_id string, chunk_index int, start bigint, end bigint"
    if gear:
        blocks = files.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(block).cast("bigint")))).repartition("file_id", "at")
        found = blocks.mapInArrow(search, "file_id string, n bigint, at bigint, found array<bigint>")
        bounds = found.repartition("file_id").sortWithinPartitions("file_id", "at").mapInArrow(choose, bounds_schema)
    else:
        bounds = files.repartition("file_id").mapInArrow(walk, bounds_schema)
    names = ["file_id", "chunk_index", "start", "end", "size", "chunk_hash"] + ["data"] * with_data

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Files()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = [held.read(name, a, b - a) for name, a, b in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True)]
                cols = [*(part.column(i) for i in range(4)), pa.array([len(d) for d in data], pa.int64()), pa.array(keyed(c.DATA_KEY, data), pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(data, pa.binary())] * with_data], names)

    spread = bounds.repartition(F.col("file_id"), F.floor(F.col("start") / block)).sortWithinPartitions("file_id", "start")
    return spread.mapInArrow(read, f"{bounds_schema}, size bigint, chunk_hash binary" + ", data binary" * with_data)


def read_xorb_ranges(ranges: DataFrame, path_col: str = "path") -> DataFrame:
    """Chunks of parts of stored xorb files: path, range_start, chunk_index,
    size, data.

    ``ranges`` has rows as :func:`fetch_plan` has them, with the file: path,
    range_start (the first chunk), byte_start and byte_end (inclusive). Nothing
    else of the file is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Files()
        for batch in batches:
            for name, first, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                got = [(name, first, first + f.index, f.size, f.data()) for f in frames(held.read(name, a, b + 1 - a))]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)], ["path", "range_start", "chunk_index", "size", "data"])

    rows = ranges.select(F.col(path_col).alias("path"), *[F.col(x).cast("bigint").alias(x) for x in ("range_start", "byte_start", "byte_end")])
    return rows.repartition("path").sortWithinPartitions("path", "byte_start").mapInArrow(run, "path string, range_start bigint, chunk_index bigint, size bigint, data binary")
