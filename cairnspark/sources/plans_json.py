"""JSON answers as rows: listings and reconstruction plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import from_api_hex

_RANGE = "struct<start: bigint, end: bigint>"
RECONSTRUCTION = f"offset_into_first_range bigint, terms array<struct<hash: string, unpacked_length: bigint, range: {_RANGE}>>, fetch_info map<string, array<struct<range: {_RANGE}, url: string, url_range: {_RANGE}>>>"
LISTING = "array<struct<type: string, path: string, size: bigint, xetHash: string>>"


def parse_reconstruction(body: Column, strict: bool = True) -> Column:
    """A reconstruction answer as a struct. A missing offset is 0, missing
    fetch_info an empty map; an answer that is no JSON object with terms raises
    InvalidResponse, or is null when not ``strict``."""
    got = F.from_json(body, RECONSTRUCTION)
    parsed = F.struct(
        F.coalesce(got["offset_into_first_range"], F.lit(0).cast("bigint")).alias("offset_into_first_range"),
        got["terms"].alias("terms"),
        F.coalesce(got["fetch_info"], F.create_map().cast("map<string, array<struct<range: struct<start: bigint, end: bigint>, url: string, url_range: struct<start: bigint, end: bigint>>>>")).alias("fetch_info"),
    )
    good = got["terms"].isNotNull() & F.forall(got["terms"], lambda t: t["hash"].rlike("^[0-9a-fA-F]{64}$") & t["range"]["start"].isNotNull() & t["range"]["end"].isNotNull() & t["unpacked_length"].isNotNull())
    ok = F.coalesce(good, F.lit(False))
    if not strict:
        return F.when(ok, parsed)
    # an error in a branch of its own: null inputs stay null
    return F.when(body.isNull(), F.lit(None)).when(ok, parsed).otherwise(F.when(F.raise_error(F.lit("InvalidResponse")).cast("string").isNull(), parsed))


def terms_of(answers: DataFrame, plan: str = "plan", id_col: str = "file_id") -> DataFrame:
    """(file_id, term_index, xorb_hash, unpacked_length, range_start,
    range_end) of parsed answers."""
    rows = answers.select(F.col(id_col).alias("file_id"), F.posexplode(f"{plan}.terms").alias("term_index", "t"))
    return rows.select("file_id", "term_index", from_api_hex(F.col("t.hash")).alias("xorb_hash"), "t.unpacked_length", F.col("t.range.start").alias("range_start"), F.col("t.range.end").alias("range_end"))


def fetch_infos(answers: DataFrame, plan: str = "plan", id_col: str = "file_id") -> DataFrame:
    """(file_id, xorb_hash, position, info_start, info_end, url, url_start,
    url_end): the fetch ranges of parsed answers, in order of position."""
    maps = answers.select(F.col(id_col).alias("file_id"), F.explode(f"{plan}.fetch_info").alias("hash", "infos"))
    rows = maps.select("file_id", from_api_hex(F.col("hash")).alias("xorb_hash"), F.posexplode("infos").alias("position", "i"))
    return rows.select("file_id", "xorb_hash", "position", F.col("i.range.start").alias("info_start"), F.col("i.range.end").alias("info_end"), "i.url", F.col("i.url_range.start").alias("url_start"), F.col("i.url_range.end").alias("url_end"))


def to_reconstruction_json(plan: DataFrame, hex_of: Column, url_of: Column) -> DataFrame:
    """(file_id, body): the answer for a fetch plan, terms in order."""
    span = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    term = F.struct("term_index", hex_of.alias("hash"), "unpacked_length", span("range_start", "range_end").alias("range"), url_of.alias("url"), span("byte_start", "byte_end").alias("url_range"))
    rows = plan.groupBy("file_id").agg(F.array_sort(F.collect_list(term)).alias("t"))
    terms = F.transform("t", lambda t: F.struct(t["hash"].alias("hash"), t["unpacked_length"].alias("unpacked_length"), t["range"].alias("range")))
    keys = F.array_distinct(F.transform("t", lambda t: t["hash"]))
    infos = F.transform(keys, lambda k: F.transform(F.filter("t", lambda t: t["hash"] == k), lambda t: F.struct(t["range"].alias("range"), t["url"].alias("url"), t["url_range"].alias("url_range"))))
    return rows.select("file_id", F.to_json(F.struct(F.lit(0).alias("offset_into_first_range"), terms.alias("terms"), F.map_from_arrays(keys, infos).alias("fetch_info"))).alias("body"))


def parse_listing(pages: DataFrame, body_col: str = "body", page_col: str = "page") -> DataFrame:
    """(ord, type, path, size, file_hash_hex): entries of listing pages, in
    page and list order."""
    rows = pages.select(F.col(page_col).alias("p"), F.posexplode(F.from_json(body_col, LISTING)).alias("i", "e"))
    return rows.select((F.col("p").cast("bigint") * F.lit(1 << 32) + F.col("i")).alias("ord"), "e.type", "e.path", "e.size", F.col("e.xetHash").alias("file_hash_hex"))
