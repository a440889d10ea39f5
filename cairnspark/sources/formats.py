"""Xorbs and shards as files, through Spark's readers or as data sources.

``read_xorbs`` and ``read_shards`` go through the binary file reader and so
reach any file system Spark does. The formats ``xorb`` and ``shard`` are Python
data sources over pyarrow's file systems (local, S3, GCS, HDFS with its library).
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from ..kernels.codec import frames, parse_shard
from ..kernels.merkle import api_hex
from ..operators.shards import shard_chunks, shard_segments
from ..operators.xorbs import read_xorb


def read_xorbs(spark: SparkSession, path: str, strict: bool = True, decode: bool = True) -> DataFrame:
    """The chunks of all ``*.xorb`` files under a path: path, chunk_index,
    ser_start, ser_end, codec, packed_size, size, data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xorb").load(path)
    return read_xorb(files.select("path", F.col("content").alias("payload")), "path", strict=strict, decode=decode)


def read_shards(spark: SparkSession, path: str, section: str = "xorbs", strict: bool = True) -> DataFrame:
    """Rows of all ``*.shard`` files under a path: ``section`` is ``xorbs`` (one
    row a chunk) or ``files`` (one row a segment)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.shard").load(path)
    rows = files.select("path", F.col("content").alias("payload"))
    return (shard_chunks if section == "xorbs" else shard_segments)(rows, "path", strict=strict)


def _listed(path: str, ending: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return fs, [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    return fs, sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(ending))


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    ending = ""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.index: int | None = None

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _listed(self.path, self.ending)[1]] or [_File("")]

    def payload(self, partition: _File) -> bytes:
        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))
        with fs.open_input_stream(partition.path) as f:
            return f.read()


class XorbReader(_Reader):
    ending = ".xorb"

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chunk_index",):
                self.index = f.value  # chunks past it are not even framed
            yield f  # Spark checks again

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        for f in frames(self.payload(partition)):
            if self.index is not None and f.index > self.index:
                return
            if self.index is None or f.index == self.index:
                yield (partition.path, f.index, f.start, f.end, f.codec, len(f.raw), f.size, f.data())


class XorbWriter(DataSourceWriter):
    """One ``<xorb hash>.xorb`` a row (xorb_hash, payload). A file is written
    under another name first, so a lost task leaves no partial xorb behind;
    names follow from contents, so a repeated task writes the same."""

    ending = ".xorb"

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        write_all(self.path, self.ending, ((bytes(r[0]), bytes(r[1])) for r in rows))
        return WriterCommitMessage()


def write_all(path: str, ending: str, rows: Iterable[tuple[bytes | str, bytes]]) -> dict[bytes | str, int]:
    """Write (name, bytes) rows as files below ``path``; rows of one name that
    follow each other are one file. The bytes written, by name."""
    fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    fs.create_dir(at, recursive=True)
    sizes: dict[bytes | str, int] = {}
    for name, parts in groupby(rows, lambda r: r[0]):
        own = f"{at}/{api_hex(name) if isinstance(name, bytes) else safe_name(name)}{ending}"
        fs.create_dir(own.rsplit("/", 1)[0], recursive=True)
        part, sizes[name] = f"{own}.{os.getpid()}.part", 0
        with fs.open_output_stream(part) as f:
            for _, payload in parts:
                f.write(payload)
                sizes[name] += len(payload)
        fs.move(part, own)
    return sizes


def safe_name(name: str) -> str:
    """A stored name as a path below a folder: names that differ stay so, and
    none leads out of it."""
    parts = [x.replace("%", "%25") for x in name.split("/")]
    return "/".join(x.replace(".", "%2E") if x in (".", "..") else x or "%" for x in parts)


class XorbSource(DataSource):
    """Format ``xorb``: reads stored chunks, writes (xorb_hash, payload)."""

    @classmethod
    def name(cls) -> str:
        return "xorb"

    def schema(self) -> str:
        return "path string, chunk_index int, ser_start bigint, ser_end bigint, codec int, packed_size bigint, size bigint, data binary"

    def reader(self, schema) -> XorbReader:
        return XorbReader(self.options)

    def writer(self, schema, overwrite: bool) -> XorbWriter:
        return XorbWriter(self.options)


class ShardReader(_Reader):
    ending = ".shard"

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        at = 0
        for x in parse_shard(self.payload(partition)).xorbs:
            for k, (h, start, size) in enumerate(x.chunks):
                yield (partition.path, at, x.xorb_hash, k, h, start, size)
                at += 1


class ShardWriter(XorbWriter):
    ending = ".shard"


class ShardSource(DataSource):
    """Format ``shard``: reads the chunk index, writes (name hash, payload)."""

    @classmethod
    def name(cls) -> str:
        return "shard"

    def schema(self) -> str:
        return "path string, position bigint, xorb_hash binary, chunk_index int, chunk_hash binary, byte_range_start bigint, size bigint"

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options)


def register_formats(spark: SparkSession) -> None:
    """Make ``spark.read.format("xorb")`` and ``format("shard")`` known."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XorbSource)
    spark.dataSource.register(ShardSource)


def write_blobs(rows: DataFrame, path: str, kind: str = "xorb") -> None:
    """Write (hash, payload) rows as files of a format, one each."""
    register_formats(rows.sparkSession)
    rows.write.format(kind).mode("append").save(path)
