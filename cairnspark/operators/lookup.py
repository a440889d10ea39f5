"""Lookups: chunk indexes, keyed shards, and ranges of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed_chunk_hash


def keyed_index(index: DataFrame, key: Column) -> DataFrame:
    """An index whose hashes are replaced by the ones a keyed shard stores."""
    return index.withColumn("chunk_hash", keyed_chunk_hash(F.col("chunk_hash"), key))


def lookup_chunks(probes: DataFrame, index: DataFrame, keys: DataFrame | None = None, position: str = "position") -> DataFrame:
    """The probes with the first place (smallest ``position``) that the index
    has of each hash, as a struct ``place``; null where it has none.

    ``keys`` (shard, key) lists keyed shards: the probe is keyed once for each
    distinct key, and matches only index rows of shards with that key. Without
    it the index is unkeyed. The index is reduced to one row a hash before the
    join, so no hash multiplies.
    """
    columns = [x for x in index.columns if x != "chunk_hash"]
    at = F.struct(*[F.col(x) for x in columns])
    if keys is None:
        first = index.groupBy("chunk_hash").agg(F.min_by(at, position).alias("place"))
        return probes.join(first, "chunk_hash", "left")
    own = index.join(keys.select("shard", "key"), "shard").withColumnRenamed("chunk_hash", "stored")
    first = own.groupBy("key", "stored").agg(F.min_by(at, F.struct("shard", position)).alias("place"))
    hashes = probes.select("chunk_hash").distinct()
    tried = reduce(DataFrame.union, [hashes.select("chunk_hash", F.explode(group).alias("key")) for group in _groups(keys)])
    tried = tried.withColumn("stored", keyed_chunk_hash(F.col("chunk_hash"), F.col("key")))
    found = tried.join(first, ["key", "stored"]).groupBy("chunk_hash").agg(F.min_by("place", F.struct(F.col("place.shard"), F.col(f"place.{position}"))).alias("place"))
    return probes.join(found, "chunk_hash", "left")


#: Distinct shard keys in one constant array.
MAX_KEYS = 1000


def _groups(keys: DataFrame) -> list[Column]:
    """The distinct keys as constant arrays of up to MAX_KEYS."""
    own = [bytes(r["key"]) for r in keys.select("key").distinct().collect()]
    groups = [own[i : i + MAX_KEYS] for i in range(0, len(own), MAX_KEYS)]
    return [F.array(*[F.lit(k) for k in g]) for g in groups] or [F.array().cast("array<binary>")]


def expand_segments(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of every segment: an equi-join on the xorb with the index
    range as the residual condition, so runs overlap at no cost.

    (file_id, segment_index, xorb_hash, chunk_index, and the chunk's other
    columns)."""
    s = segments.select("file_id", "segment_index", F.col("xorb_hash").alias("__x"), "chunk_index_start", "chunk_index_end")
    on = (F.col("__x") == F.col("xorb_hash")) & (F.col("chunk_index") >= F.col("chunk_index_start")) & (F.col("chunk_index") < F.col("chunk_index_end"))
    return s.join(chunks, on).drop("__x", "chunk_index_start", "chunk_index_end")


def fetch_plan(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """The terms of files, planned from the local index: file_id, term_index,
    xorb_hash, range_start, range_end, unpacked_length, byte_start, byte_end
    (the inclusive bytes of the stored xorb that hold the term)."""
    rows = expand_segments(segments, chunks.select("xorb_hash", "chunk_index", "size", "ser_start", "ser_end"))
    return rows.groupBy("file_id", F.col("segment_index").alias("term_index")).agg(
        F.min("xorb_hash").alias("xorb_hash"),
        F.min("chunk_index").alias("range_start"),
        (F.max("chunk_index") + 1).alias("range_end"),
        F.sum("size").cast("bigint").alias("unpacked_length"),
        F.min("ser_start").alias("byte_start"),
        (F.max("ser_end") - 1).alias("byte_end"),
    )


def _ranges_by_xorb(infos: DataFrame) -> DataFrame:
    """(xorb_hash, infos): the distinct ranges of each xorb in order of position,
    each by its first info."""
    info = F.struct("position", "info_start", "info_end", "url", "url_start", "url_end")
    first = infos.groupBy("xorb_hash", "info_start", "info_end").agg(F.min(info).alias("info"))
    return first.groupBy("xorb_hash").agg(F.array_sort(F.collect_list("info")).alias("infos"))


def match_fetch_ranges(terms: DataFrame, infos: DataFrame, strict: bool = True) -> DataFrame:
    """Each term with the first fetch range (by ``position``) of its xorb that
    contains its chunk range, and the term's range within it.

    ``terms``: file_id, term_index, xorb_hash, range_start, range_end.
    ``infos``: xorb_hash, position, info_start, info_end, url, url_start,
    url_end. Adds url, url_start, url_end, local_start, local_end and error:
    MissingFetchInfo (the xorb has no range) or NoMatchingFetchInfo (none holds
    the term), which raise when ``strict``.

    Of equal ranges of a xorb the first alone is kept, and what is left is
    gathered per xorb: its chunks bound how many ranges are compared with a term,
    however often they are listed. A term is one row throughout and is shuffled
    once, for the join.
    """
    keys = ["file_id", "term_index", "xorb_hash", "range_start", "range_end"]
    held = _ranges_by_xorb(infos)
    fits = F.filter("infos", lambda i: (i["info_start"] <= F.col("range_start")) & (i["info_end"] >= F.col("range_end")))
    got = terms.select(*keys).join(held, "xorb_hash", "left").select(*keys, F.col("infos").isNotNull().alias("any"), F.get(fits, F.lit(0)).alias("i"))
    error = F.when(~F.col("any"), F.lit("MissingFetchInfo")).when(F.col("i").isNull(), F.lit("NoMatchingFetchInfo"))
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    return got.select(
        *keys,
        F.col("i.url").alias("url"),
        F.col("i.url_start").alias("url_start"),
        F.col("i.url_end").alias("url_end"),
        (F.col("range_start") - F.col("i.info_start")).alias("local_start"),
        (F.col("range_end") - F.col("i.info_start")).alias("local_end"),
        error.alias("error"),
    )
