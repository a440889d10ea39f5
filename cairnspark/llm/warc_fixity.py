"""WARC fixity audit with Merkle trees over records and offset ranges.

A replica is a table of WARC records (file, offset, block or its SHA-256). Each
record becomes a leaf: SHA-256 over its offset, length and block's digest, so
blocks are read once, where they lie, and never shuffled. Leaves in offset order
form a tree of FANOUT children a node per file; a node's hash also covers the offset
range that it spans. Two replicas are compared at the roots, and only children
of mismatching nodes are compared further down, so a clean file costs one row
and a corrupt record one path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, id_bounds, long_array, materialize

FANOUT = 16
#: Records to a WARC file, at most.
FILE_RECORDS = 2000
#: Ranges of ids that are numbered side by side; bounds what the driver plans.
#: Files grow with the records, and so does what is numbered in a range.
MAX_RANGES = 4096


def warc_block(url: Column, body: Column) -> Column:
    """The bytes of a WARC response record."""
    payload = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), payload, F.lit(b"\r\n\r\n"))


def _placed(rows: DataFrame, n_files: int | None) -> DataFrame:
    """``rows`` (page_id, length, digest, ...) with file, seq and offset: by id
    (nulls first), then digest. A file holds FILE_RECORDS records of a range of
    ids, or a range itself where ``n_files`` ranges are asked for."""
    ranges = n_files or min(MAX_RANGES, max(1, -(-rows.select("page_id").count() // FILE_RECORDS)))
    rows = rows.withColumn("range", bucket_of(F.col("page_id"), id_bounds(rows, "page_id", ranges)))
    own = Window.partitionBy("range").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    rows = rows.withColumn("n", F.row_number().over(own).cast("bigint") - 1)
    if n_files:
        rows = rows.withColumn("file", F.col("range")).withColumn("seq", F.col("n"))
    else:
        sizes = {r["range"]: r["n"] for r in rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
        first, at = [], 0
        for k in range(max(sizes, default=-1) + 1):
            first.append(at)
            at += -(-sizes.get(k, 0) // FILE_RECORDS)
        of = F.get(long_array(first), F.col("range")) if first else F.lit(0)
        rows = rows.withColumn("file", (of + F.floor(F.col("n") / FILE_RECORDS)).cast("bigint")).withColumn("seq", F.col("n") % FILE_RECORDS)
    before = Window.partitionBy("range", "file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")).drop("range", "n")


def _records(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), warc_block(F.col(url_col), F.col(body_col)).alias("block"))
    return rows.withColumn("length", F.length("block").cast("bigint"))


def to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", n_files: int | None = None) -> DataFrame:
    """Pages as WARC records: file, seq, page_id, offset, length, block, for
    writing files; :func:`inventory` has the same records without the blocks.

    Files hold contiguous ids; within a file records stand by id (nulls first),
    then by content. Offsets are running byte sums. Null urls and bodies are
    empty; repeated rows are records of their own; an empty table gives none.
    Blocks travel with the records to their files.
    """
    rows = _records(pages, id_col, url_col, body_col).withColumn("digest", F.sha2("block", 256))
    return _placed(rows, n_files).select("file", "seq", "page_id", "offset", "length", "block")


def inventory(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", n_files: int | None = None, replica: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records as in :func:`to_warc`, with the block's SHA-256 (digest) in its
    place, taken where the block is read. ``replica`` makes another copy of the
    records (page_id, length, block), whose blocks' digests are ``copied``."""
    rows = _records(pages, id_col, url_col, body_col)
    rows = rows.withColumn("digest", F.sha2("block", 256))
    out = ["file", "seq", "page_id", "offset", "length", "digest"]
    if replica:
        rows, out = replica(rows).withColumn("copied", F.sha2("block", 256)), [*out, "copied"]
    return _placed(rows.drop("block"), n_files).select(*out)


def leaves(records: DataFrame) -> DataFrame:
    """(file, idx, start, stop, hash) of records (file, seq, offset, length,
    block or digest): the hash is over offset, length and the block's digest."""
    head = F.concat_ws(",", F.col("offset").cast("string"), F.col("length").cast("string"))
    digest = F.col("digest") if "digest" in records.columns else F.sha2(F.coalesce("block", F.lit(b"")), 256)
    return records.select(
        "file",
        F.col("seq").alias("idx"),
        F.col("offset").alias("start"),
        (F.col("offset") + F.col("length")).alias("stop"),
        F.sha2(F.concat(head, F.lit(":"), digest).cast("binary"), 256).alias("hash"),
    )


def parents(level: DataFrame) -> DataFrame:
    """The level above: FANOUT children a node, hashed in order with the range."""
    kids = level.groupBy("file", F.floor(F.col("idx") / FANOUT).cast("bigint").alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "start", "stop", "hash"))).alias("k")
    )
    start, stop = F.get("k.start", F.lit(0)), F.array_max("k.stop")
    joined = F.concat_ws(",", start.cast("string"), stop.cast("string"), F.array_join("k.hash", ","))
    return kids.select("file", F.col("up").alias("idx"), start.alias("start"), stop.alias("stop"), F.sha2(joined.cast("binary"), 256).alias("hash"))


def trees(records: DataFrame) -> list[DataFrame]:
    """All levels, leaves first, each written to the shared folder; the last
    has one root a file."""
    levels = [materialize(leaves(records), "warc-leaves")]
    while (levels[-1].agg(F.max("idx").alias("m")).first()["m"] or 0) > 0:
        levels.append(materialize(parents(levels[-1]), "warc-nodes"))
    return levels


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records where two replicas differ: file, idx, start_a, stop_a, start_b,
    stop_b, fault ('content', 'moved' for a changed offset or length,
    'missing' in b, 'extra' in b).

    Compares roots, then descends level by level into mismatching nodes alone.
    Records are matched by position in the file, so one that is missing in the
    middle shows as everything after it having moved. Empty replicas differ in
    all of the other's records; identical ones give no rows.
    """
    ta, tb = trees(a), trees(b)
    while len(ta) < len(tb):  # a shallower tree repeats its root's level
        ta.append(materialize(parents(ta[-1]), "warc-nodes"))
    while len(tb) < len(ta):
        tb.append(materialize(parents(tb[-1]), "warc-nodes"))
    suspects = None
    for depth in range(len(ta) - 1, -1, -1):
        x, y = ta[depth], tb[depth]
        if suspects is not None:
            up = F.floor(F.col("idx") / FANOUT).cast("bigint")
            within = suspects.withColumnRenamed("idx", "up")
            x = x.withColumn("up", up).join(within, ["file", "up"], "left_semi").drop("up")
            y = y.withColumn("up", up).join(within, ["file", "up"], "left_semi").drop("up")
        both = x.alias("a").join(y.alias("b"), ["file", "idx"], "full").filter(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        if depth:
            suspects = materialize(both.select("file", "idx"), "warc-suspects")
    fault = (
        F.when(F.col("b.hash").isNull(), "missing")
        .when(F.col("a.hash").isNull(), "extra")
        .when((F.col("a.start") != F.col("b.start")) | (F.col("a.stop") != F.col("b.stop")), "moved")
        .otherwise("content")
    )
    return both.select("file", "idx", F.col("a.start").alias("start_a"), F.col("a.stop").alias("stop_a"), F.col("b.start").alias("start_b"), F.col("b.stop").alias("stop_b"), fault.alias("fault"))


def decayed(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A replica with bit rot: where crc32 of the id as text is a multiple of
    97, the byte in the middle of the block has its lowest bit flipped."""
    middle = F.floor(F.col("length") / 2).cast("int")
    # hex keeps every byte; the flipped digit is the second of the pair
    pair = F.conv(F.hex(F.substring("block", middle + 1, F.lit(1))), 16, 10).cast("int")
    flipped = F.unhex(F.lpad(F.hex(pair.bitwiseXOR(F.lit(1))), 2, "0"))
    broken = F.concat(F.substring("block", F.lit(1), middle), flipped, F.substring("block", middle + 2, F.length("block")))
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 97 == 0
    return records.withColumn("block", F.when(hit, broken).otherwise(F.col("block")))
