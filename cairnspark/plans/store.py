"""A Parquet store of xorbs, segments and names, committed in that order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import latest_entries, put_if_absent
from ..operators.reconstruct import reconstruct, reconstruct_range, reconstruct_stream
from ..shared import exists, keep
from .ingest import Ingested, ingest

SCHEMAS = {
    "xorbs": "xorb_hash binary, chunk_count bigint, total_raw_bytes bigint, serialized_size bigint, payload binary",
    "xorb_chunks": "xorb_hash binary, chunk_index int, chunk_hash binary, byte_range_start bigint, size bigint, ser_start bigint, ser_end bigint",
    "file_segments": "file_hash binary, segment_index int, xorb_hash binary, chunk_index_start int, chunk_index_end int, unpacked_segment_size bigint",
    "catalog": "namespace string, path string, size bigint, file_hash binary, version bigint, mtime bigint",
}


class Store:
    """Tables are folders of Parquet under ``path``, appended to and never
    rewritten. Each commit writes its rows of every table, then one row to the
    table of commits; rows are read if their commit is there. A commit that
    fails anywhere before that is as if it had not been (its files stay, unread),
    and running it again adds nothing twice. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """The rows of all commits."""
        if not exists(self.spark, f"{self.path}/commits") or not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], SCHEMAS[name])
        done = self.spark.read.schema("commit string").parquet(f"{self.path}/commits")
        rows = self.spark.read.schema(f"{SCHEMAS[name]}, commit string").parquet(f"{self.path}/{name}")
        return rows.join(done, "commit", "left_semi").drop("commit")

    def _append(self, name: str, commit: str, rows: DataFrame) -> None:
        rows.select(*[F.col(f.split()[0]) for f in SCHEMAS[name].split(", ")]).write.parquet(f"{self.path}/{name}/commit={commit}")

    def known(self) -> DataFrame:
        """One place of each stored chunk, as :func:`ingest` takes it."""
        at = F.min(F.struct("xorb_hash", "chunk_index", "size")).alias("at")
        got = self.table("xorb_chunks").groupBy("chunk_hash").agg(at)
        return got.select("chunk_hash", "at.xorb_hash", F.col("at.chunk_index").alias("xorb_chunk"), "at.size")

    def put(self, files: DataFrame, namespace: str, id_col: str = "file_id", data_col: str = "content", version: int = 0, **options) -> DataFrame:
        """Ingest files and register them by id. Returns (file_id, file_hash,
        file_size, chunk_count, was_inserted)."""
        done = ingest(files, id_col, data_col, known=self.known(), **options)
        return self.commit(done, namespace, version)

    def commit(self, done: Ingested, namespace: str, version: int = 0) -> DataFrame:
        commit = uuid.uuid4().hex
        held = self.table("xorbs").select("xorb_hash")
        new = done.xorbs.dropDuplicates(["xorb_hash"]).join(held, "xorb_hash", "left_anti")
        self._append("xorbs", commit, new)
        index = done.xorb_chunks.dropDuplicates(["xorb_hash", "chunk_index"]).join(held, "xorb_hash", "left_anti")
        self._append("xorb_chunks", commit, index)
        marked = keep(put_if_absent(self.table("file_segments"), done.hashes, "file_hash", ["file_id"]), "marked")
        self._append("file_segments", commit, done.segments.join(marked.filter("was_inserted").select("file_id", "file_hash"), "file_id"))
        self._append("catalog", commit, marked.select(F.lit(namespace).alias("namespace"), F.col("file_id").cast("string").alias("path"), F.col("file_size").alias("size"), "file_hash", F.lit(version).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("mtime")))
        self.spark.createDataFrame([(commit,)], "commit string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return marked

    def names(self) -> DataFrame:
        """(namespace, path, size, file_hash, mtime): the newest entry a path."""
        return latest_entries(self.table("catalog").withColumnRenamed("file_hash", "file_hash_hex")).withColumnRenamed("file_hash_hex", "file_hash")

    def get(self, wanted: DataFrame, strict: bool = True) -> DataFrame:
        """(file_hash, content, error) of files by hash, (file_hash) in
        ``wanted``. All in one job; not strict, one bad file fails alone."""
        segments = self._segments(wanted)
        return reconstruct(segments, self.table("xorb_chunks"), self.table("xorbs"), strict).withColumnRenamed("file_id", "file_hash")

    def get_range(self, wanted: DataFrame, strict: bool = True) -> DataFrame:
        """As :meth:`get`, of bytes [range_start, range_end)."""
        ranges = wanted.withColumnRenamed("file_hash", "file_id")
        return reconstruct_range(self._segments(wanted), self.table("xorb_chunks"), self.table("xorbs"), ranges, strict).withColumnRenamed("file_id", "file_hash")

    def stream(self, wanted: DataFrame) -> DataFrame:
        """(file_hash, offset, data): files of any size as ordered rows."""
        return reconstruct_stream(self._segments(wanted), self.table("xorb_chunks"), self.table("xorbs")).withColumnRenamed("file_id", "file_hash")

    def _segments(self, wanted: DataFrame) -> DataFrame:
        return self.table("file_segments").join(wanted.select("file_hash").distinct(), "file_hash").withColumnRenamed("file_hash", "file_id")
