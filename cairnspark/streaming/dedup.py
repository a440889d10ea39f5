"""Chunks of a stream of files, and dedup across micro-batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunking import chunk_files
from ..shared import exists


def stream_chunks(files: DataFrame, id_col: str = "file_id", data_col: str = "content", **chunking) -> DataFrame:
    """Chunks of a streaming (or static) table of files."""
    return chunk_files(files, id_col, data_col, **chunking)


def distinct_chunks(chunks: DataFrame, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each chunk hash in Spark's own state store. With a
    time column, hashes older than the watermark are forgotten (and late rows
    dropped); without one the state holds every hash ever seen."""
    if time_col:
        return chunks.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["chunk_hash"])
    return chunks.dropDuplicates(["chunk_hash"])


def append_new_chunks(chunks: DataFrame, path: str, checkpoint: str, order: tuple[str, ...] = ("file_id", "chunk_index")) -> StreamingQuery:
    """Start a query that appends to ``path`` the chunks it lacks, once each.

    The store itself is the state: a batch is reduced to first occurrences and
    anti-joined with it, so memory does not grow with what has been seen. Each
    batch of a query (which its checkpoint identifies) has a folder of its own,
    which a repeated batch overwrites: exactly once, whatever fails. A store may
    be filled by any number of queries, one at a time.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        rows = [F.col(x) for x in batch.columns if x != "chunk_hash"]
        first = batch.groupBy("chunk_hash").agg(F.min_by(F.struct(*rows), F.struct(*order)).alias("r")).select("chunk_hash", "r.*")
        if exists(spark, path):
            held = spark.read.schema("chunk_hash binary, query string, batch bigint").parquet(path)
            first = first.join(held.filter((F.col("query") != query) | (F.col("batch") != number)).select("chunk_hash"), "chunk_hash", "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/query={query}/batch={number}")

    return chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressListener(StreamingQueryListener):
    """Calls back with (bytes completed, bytes in all) after each batch, one
    call at a time, never going back. Bytes are the sum of ``size_col`` that the
    stream reports of itself (see :func:`with_progress`); the total is what the
    caller knows, or the same number while it knows none."""

    def __init__(self, callback: Callable[[int, int], None], total: int | None = None):
        self.callback, self.done, self.total = callback, 0, total

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(PROGRESS)
        self.done += int(seen["bytes"] or 0) if seen else 0
        self.callback(self.done, max(self.done, self.total or 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


#: Name of the metric that :func:`with_progress` adds.
PROGRESS = "cairnspark_progress"


def with_progress(chunks: DataFrame, size_col: str = "size") -> DataFrame:
    """The rows, which now tell a :class:`ProgressListener` of their bytes."""
    return chunks.observe(PROGRESS, F.sum(size_col).alias("bytes"))
