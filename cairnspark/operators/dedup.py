"""Chunk dedup: first occurrences, savings, and probes of known chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_occurrences(chunks: DataFrame, order: tuple[str, ...] = ("file_id", "chunk_index")) -> DataFrame:
    """One row a distinct chunk: chunk_hash, size, copies, and the first place
    (``first``: a struct of the ``order`` columns). Partial minima are formed
    before the shuffle, so a hash of any number of copies is no hot spot."""
    at = F.struct(*[F.col(x) for x in order])
    return chunks.groupBy("chunk_hash").agg(F.min(at).alias("first"), F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def mark_duplicates(chunks: DataFrame, order: tuple[str, ...] = ("file_id", "chunk_index")) -> DataFrame:
    """The chunks with ``is_new``: whether the row is its hash's first; of rows
    that repeat (a file listed twice) one is."""
    first = first_occurrences(chunks, order).select("chunk_hash", "first")
    at = F.struct(*[F.col(x) for x in order])
    own = Window.partitionBy("chunk_hash", *order).orderBy(F.lit(0))  # rows that repeat, no hot hash's
    got = chunks.withColumn("copy", F.row_number().over(own)).join(first, "chunk_hash")
    return got.withColumn("is_new", (at == F.col("first")) & (F.col("copy") == 1)).drop("first", "copy")


def chunk_stats(marked: DataFrame, *by: str) -> DataFrame:
    """Counts and bytes of marked chunks, per ``by`` group: chunks,
    unique_chunks, raw_bytes, unique_bytes, dedup_savings, savings_pct."""
    new = F.when(F.col("is_new"), F.col("size")).otherwise(F.lit(0))
    got = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("is_new").alias("unique_chunks"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("raw_bytes"),
        F.coalesce(F.sum(new), F.lit(0)).cast("bigint").alias("unique_bytes"),
    )
    saved = F.col("raw_bytes") - F.col("unique_bytes")
    return got.withColumn("dedup_savings", saved).withColumn("savings_pct", F.when(F.col("raw_bytes") > 0, saved * 100.0 / F.col("raw_bytes")).otherwise(F.lit(0.0)))


def known_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose hash the index has."""
    return chunks.join(index.select("chunk_hash"), "chunk_hash", "left_semi")


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose hash the index lacks."""
    return chunks.join(index.select("chunk_hash"), "chunk_hash", "left_anti")
