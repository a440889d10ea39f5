"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as op
from .operators.catalog import numbered, registration_lines
from .plans import convert_stats, ingest
from .shared import fresh_dir, keep
from .sources import fetch_infos, parse_listing, parse_reconstruction, read_xorb_ranges, terms_of, to_reconstruction_json, write_blobs
from .streaming import append_new_chunks, stream_chunks

#: Cap of the packing queries, small enough that every source fills several.
PACK_CAP = 65536


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


# -- chunking and dedup ------------------------------------------------------


def _doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op.chunk_files(_doc_files(spark, sf_dir), with_data=False)
    return got.select(F.col("file_id").alias("doc_id"), "chunk_index", "start", "end", "size")


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("content"))
    return op.chunk_files(pages).select(F.col("file_id").alias("page_id"), "chunk_index", "size", _sha(F.col("data")).alias("chunk_sha256"))


def dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much documents shrink by content-defined dedup, per source."""
    docs = _table(spark, sf_dir, "documents").select(F.struct("doc_id", "source").alias("file_id"), F.col("text").alias("content"))
    chunks = op.chunk_files(docs, with_data=False).withColumn("source", F.col("file_id.source")).withColumn("doc_id", F.col("file_id.doc_id"))
    marked = op.mark_duplicates(chunks.drop("file_id"), ("doc_id", "chunk_index"))
    return op.chunk_stats(marked, "source").drop("savings_pct")


def _turn_chunks(spark: SparkSession, sf_dir: str, with_data: bool = False) -> DataFrame:
    """Turns as files: file_id is struct(conv_id, turn)."""
    turns = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn", "role").alias("file_id"), F.col("text").alias("content"))
    got = op.chunk_files(turns, with_data=with_data)
    return got.select("file_id.conv_id", "file_id.turn", "file_id.role", *got.columns[1:])


def turn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_chunks(spark, sf_dir, with_data=True).withColumn("chunk_sha256", _sha(F.col("data"))).drop("data")
    order = ("conv_id", "turn", "chunk_index", "chunk_sha256")
    got = op.first_occurrences(chunks, order)
    return got.select("first.chunk_sha256", "first.conv_id", "first.turn", "size", "copies")


def new_vs_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against an index of all other roles' chunks."""
    chunks = _turn_chunks(spark, sf_dir)
    probe, index = chunks.filter("role = 'assistant'"), chunks.filter("role <> 'assistant'")
    known, new = op.known_chunks(probe, index), op.new_chunks(probe, index)
    rows = known.withColumn("known", F.lit(True)).unionByName(new.withColumn("known", F.lit(False)))
    return rows.groupBy("known").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_hash").alias("distinct_chunks"), F.sum("size").alias("bytes"))


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 64 neighbouring documents each."""
    docs = _table(spark, sf_dir, "documents").withColumn("file_id", F.floor(F.col("doc_id") / 64))
    return op.pack_files(docs, ["file_id"], "doc_id", "text")


def bundle_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files of a hundred kilobytes and more are cut."""
    got = op.chunk_files(_bundles(spark, sf_dir), with_data=False)
    return got.select("file_id", "chunk_index", "start", "end", "size")


def bundle_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = op.chunk_files(_bundles(spark, sf_dir), with_data=False)
    return op.chunk_stats(op.mark_duplicates(chunks), "file_id").drop("savings_pct")


def ultracdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op.chunk_files(_doc_files(spark, sf_dir), algorithm="ultracdc", with_data=False)
    return got.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


# -- hashes ------------------------------------------------------------------


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _doc_files(spark, sf_dir)
    got = op.file_hashes(op.chunk_files(files, with_data=False), files)
    return got.select("file_id", fn.api_hex(F.col("file_hash")).alias("file_hash_hex"), "file_size", "chunk_count")


def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree over each source's document hashes."""
    docs = _table(spark, sf_dir, "documents").filter("text is not null and source is not null")
    nodes = docs.select("source", "doc_id", fn.data_hash(F.col("text")).alias("chunk_hash"), F.octet_length("text").cast("bigint").alias("size"))
    got = op.tree_roots(nodes, "source", "doc_id")
    return got.select("source", fn.api_hex(F.col("root")).alias("root_hex"), "size", "chunk_count")


def merkle_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level's groups over each conversation's turn digests."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("chunk_hash"))
    return op.merkle_groups(turns, "conv_id", "turn").select("conv_id", "turn", F.col("group").alias("group_no"))


def api_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.unhex(_sha(F.coalesce("text", F.lit(""))))
    text = fn.api_hex(h)
    return _table(spark, sf_dir, "documents").select("doc_id", text.alias("api_hex"), F.lower(F.hex(fn.from_api_hex(text))).alias("sha256"))


# -- xorbs -------------------------------------------------------------------


def _doc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ready-made chunks of their source's file."""
    docs = _table(spark, sf_dir, "documents").filter("text is not null and source is not null")
    data = F.col("text").cast("binary")
    return docs.select(F.col("source").alias("file_id"), F.col("doc_id").cast("int").alias("chunk_index"), fn.data_hash(data).alias("chunk_hash"), F.length(data).cast("bigint").alias("size"), data.alias("data"))


def xorb_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op.raw_offsets(op.assign_xorbs(_doc_units(spark, sf_dir).drop("data"), cap=PACK_CAP))
    return placed.select(F.col("file_id").alias("source"), F.col("chunk_index").cast("bigint").alias("doc_id"), "size", "xorb_index", "xorb_chunk", "byte_range_start")


def xorb_pack_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the cap on raw bytes: no header is counted."""
    placed = op.assign_xorbs(_doc_units(spark, sf_dir).drop("data"), cap=PACK_CAP, overhead=0)
    return placed.groupBy(F.col("file_id").alias("source"), "xorb_index").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("raw_bytes"))


def xorb_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    return _table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(fn.chunk_header(n, fn.codec_code(F.lit("none")), n))).alias("header"))


def xorb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into compressed xorbs and back."""
    units = _doc_units(spark, sf_dir)
    xorbs = op.build_xorbs(op.assign_xorbs(units.drop("data"), cap=PACK_CAP), units, "bg4")
    rows = op.read_xorb(xorbs.select(F.struct("file_id", "xorb_index").alias("id"), "payload"), "id")
    return rows.select(F.col("id.file_id").alias("source"), "id.xorb_index", F.col("chunk_index").alias("xorb_chunk"), "size", _sha(F.col("data")).alias("chunk_sha256"))


def xorb_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks [1, 3) of each xorb, or the error where it has fewer."""
    units = _doc_units(spark, sf_dir)
    xorbs = op.build_xorbs(op.assign_xorbs(units.drop("data"), cap=PACK_CAP), units, "lz4")
    got = xorbs.withColumn("r", op.extract_range(F.col("payload"), F.lit(1), F.lit(3), strict=False))
    return got.select(F.col("file_id").alias("source"), "xorb_index", _sha(F.col("r.data")).alias("range_sha256"), "r.error")


def chunk_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second chunk of each xorb, alone."""
    units = _doc_units(spark, sf_dir)
    xorbs = op.build_xorbs(op.assign_xorbs(units.drop("data"), cap=PACK_CAP), units, "fbs")
    got = op.read_chunk(xorbs.select(F.struct("file_id", "xorb_index").alias("id"), "payload"), 1, "id", strict=False)
    return got.select(F.col("id.file_id").alias("source"), "id.xorb_index", _sha(F.col("data")).alias("chunk_sha256"), "error")


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for codec in ("none", "lz4", "bg4", "fbs"):
        docs = _doc_files(spark, sf_dir).filter("content is not null").withColumn("n", F.octet_length("content"))
        packed = docs.withColumn("p", fn.compress_chunk(F.col("content"), codec))
        plain = packed.withColumn("plain", fn.decompress_chunk(F.col("p.data"), F.col("p.codec"), F.col("n")))
        rows = plain.select(F.col("file_id").alias("doc_id"), F.lit(codec).alias("codec"), F.length("plain").cast("bigint").alias("size"), _sha(F.col("plain")).alias("sha256"))
        out = rows if out is None else out.union(rows)
    return out


def byte_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    return _table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.hex(fn.byte_group(text))).alias("grouped"), F.lower(F.hex(fn.transform_bytes(fn.transform_bytes(text, "bg4"), "bg4_inverse"))).alias("back"))


def bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    return _table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.hex(fn.transform_bytes(text, "fbs"))).alias("sliced"))


def vector_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored size of each embedding's float32 bytes by codec (rows only: the
    LZ4 encoder is free to choose)."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", fn.float_bytes(F.col("embedding")).alias("data"))
    kinds = {k: fn.compress_chunk(F.col("data"), k) for k in ("lz4", "bg4", "fbs")}
    got = rows.select("vec_id", F.length("data").alias("raw"), *[v.alias(k) for k, v in kinds.items()])
    return got.select("vec_id", "raw", *[F.length(f"{k}.data").alias(f"{k}_bytes") for k in kinds])


# -- conversations as files of turns: segments, plans, reconstruction ----------


def _conversation_tables(spark: SparkSession, sf_dir: str, codec: str = "none") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, xorb chunks, xorbs) of conversations whose chunks are turns,
    each stored once, by the conversation that has it first."""
    turns = _table(spark, sf_dir, "conversations").filter("text <> ''")
    chunks = turns.select(F.col("conv_id").alias("file_id"), F.col("turn").cast("int").alias("chunk_index"), fn.data_hash(F.col("text")).alias("chunk_hash"), F.octet_length("text").cast("bigint").alias("size"), F.col("text").cast("binary").alias("data"))
    first = op.first_occurrences(chunks).select("first.file_id", "first.chunk_index", "chunk_hash", "size")
    xorbs = keep(op.build_xorbs(op.assign_xorbs(first), chunks, codec), "turn-xorbs")
    index = op.xorb_chunks(xorbs)
    places = index.select("chunk_hash", "xorb_hash", F.col("chunk_index").alias("xorb_chunk"), "size")
    return keep(op.file_segments(chunks, places), "turn-segments"), index, xorbs


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, _ = _conversation_tables(spark, sf_dir)
    return segments.select(F.col("file_id").alias("conv_id"), "segment_index", "chunk_index_start", "chunk_index_end", "unpacked_segment_size")


def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, index, _ = _conversation_tables(spark, sf_dir)
    got = op.fetch_plan(segments, index)
    return got.select(F.col("file_id").alias("conv_id"), "term_index", "range_start", "range_end", "unpacked_length", "byte_start", "byte_end")


def reconstruct_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op.reconstruct(*_conversation_tables(spark, sf_dir, "lz4"))
    return got.select(F.col("file_id").alias("conv_id"), F.length("content").cast("bigint").alias("size"), _sha(F.col("content")).alias("sha256"), "error")


def reconstruct_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third of each conversation's bytes."""
    tables = _conversation_tables(spark, sf_dir, "bg4")
    n = F.sum("unpacked_segment_size").cast("bigint")
    ranges = tables[0].groupBy("file_id").agg(F.floor(n / 3).alias("range_start"), F.floor(2 * n / 3).alias("range_end"))
    got = op.reconstruct_range(*tables, ranges)
    return got.select(F.col("file_id").alias("conv_id"), F.length("content").cast("bigint").alias("size"), _sha(F.col("content")).alias("sha256"), "error")


def stream_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op.reconstruct_stream(*_conversation_tables(spark, sf_dir, "lz4"))
    return got.select(F.col("file_id").alias("conv_id"), "offset", F.length("data").cast("bigint").alias("size"), _sha(F.col("data")).alias("sha256"))


def lost_xorbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conversations still come out where xorbs of over six turns are lost."""
    segments, index, xorbs = _conversation_tables(spark, sf_dir, "lz4")
    got = op.reconstruct(segments, index, xorbs.filter("chunk_count <= 6"), strict=False)
    return got.select(F.col("file_id").alias("conv_id"), "error")


def spoiled_xorbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where only the last byte of those xorbs is another."""
    segments, index, xorbs = _conversation_tables(spark, sf_dir)
    cut = F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(b"\0"))
    got = op.reconstruct(segments, index, xorbs.withColumn("payload", F.when(F.col("chunk_count") > 6, cut).otherwise(F.col("payload"))), strict=False)
    return got.select(F.col("file_id").alias("conv_id"), _sha(F.col("content")).alias("sha256"), "error")


def xorb_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Xorbs as files, of which each term's bytes alone are read."""
    segments, index, xorbs = _conversation_tables(spark, sf_dir, "lz4")
    at = fresh_dir(spark, "xorb-files")
    write_blobs(xorbs.select("xorb_hash", "payload"), at)
    plan = op.fetch_plan(segments, index).withColumn("path", F.concat(F.lit(f"{at}/"), fn.api_hex(F.col("xorb_hash")), F.lit(".xorb")))
    chunks = read_xorb_ranges(plan.select("path", "range_start", "byte_start", "byte_end").distinct())
    return chunks.select("range_start", "chunk_index", "size", _sha(F.col("data")).alias("chunk_sha256"))


def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversion saves of each document, without compression."""
    files = _doc_files(spark, sf_dir)
    return convert_stats(files, ingest(files, codec="none")).select(F.col("file_id").alias("doc_id"), F.round("compression_pct", 4).alias("compression_pct"))


def convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what a conversion reports, without compression."""
    files = _doc_files(spark, sf_dir)
    return convert_stats(files, ingest(files, codec="none")).drop("compression_pct").withColumnRenamed("file_id", "doc_id")


def reconstruction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch plans out to JSON and in again, and matched to their ranges."""
    segments, index, _ = _conversation_tables(spark, sf_dir)
    plan = op.fetch_plan(segments, index)
    body = to_reconstruction_json(plan, fn.api_hex(F.col("xorb_hash")), F.concat(F.lit("store/"), fn.api_hex(F.col("xorb_hash"))))
    answers = body.select("file_id", parse_reconstruction(F.col("body")).alias("plan"))
    terms = terms_of(answers)
    infos = fetch_infos(answers)
    # a range per term: the first that holds it may be an earlier term's
    got = op.match_fetch_ranges(terms, infos.drop("file_id").dropDuplicates(["xorb_hash", "info_start", "info_end"]).withColumn("position", F.col("info_start") * F.lit(1 << 20) + F.col("info_end")))
    return got.select(F.col("file_id").alias("conv_id"), "term_index", "range_start", "range_end", "error")


# -- lookups -----------------------------------------------------------------


def fetch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as terms of their supplier, parts as that supplier's ranges."""
    lines = _table(spark, sf_dir, "lineitem")
    terms = lines.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("term_index"), (F.col("l_partkey") % 1000).alias("xorb_hash"), F.col("l_linenumber").cast("bigint").alias("range_start"), (F.col("l_linenumber") + F.col("l_quantity")).cast("bigint").alias("range_end"))
    parts = _table(spark, sf_dir, "part")
    infos = parts.select((F.col("p_partkey") % 1200).alias("xorb_hash"), F.col("p_partkey").alias("position"), (F.col("p_size") % 5).cast("bigint").alias("info_start"), (F.col("p_size") + 5).cast("bigint").alias("info_end"), F.col("p_name").alias("url"), F.lit(0).cast("bigint").alias("url_start"), F.col("p_size").cast("bigint").alias("url_end"))
    got = op.match_fetch_ranges(terms, infos, strict=False)
    return got.groupBy("error", "url").agg(F.count(F.lit(1)).alias("terms"), F.sum("local_start").alias("local_start"), F.sum("local_end").alias("local_end"))


def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns looked up in shards by role, each keyed with a key of its own."""
    rows = _table(spark, sf_dir, "conversations").filter("text <> ''")
    rows = rows.select("conv_id", "turn", F.col("role").alias("shard"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), fn.data_hash(F.col("text")).alias("chunk_hash"))
    keys = rows.select("shard").distinct().withColumn("key", F.unhex(F.sha2(F.col("shard").cast("binary"), 256)))
    index = rows.join(keys, "shard").withColumn("chunk_hash", fn.keyed_chunk_hash(F.col("chunk_hash"), F.col("key"))).select("shard", "position", "chunk_hash")
    got = op.lookup_chunks(rows.select("conv_id", "turn", "chunk_hash"), index, keys)
    return got.select("conv_id", "turn", "place.shard", "place.position")


def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation tables into sixteen shards and back: the file section."""
    segments, index, xorbs = _conversation_tables(spark, sf_dir)
    shard_of = lambda h: F.conv(F.substring(F.hex(h), 1, 1), 16, 10).cast("int")
    file_hash = F.unhex(F.sha2(F.col("file_id").cast("string").cast("binary"), 256))
    files = segments.withColumn("file_hash", file_hash).withColumn("shard", shard_of(file_hash)).withColumn("range_hash", F.lit(None).cast("binary"))
    chunks = index.join(xorbs.select("xorb_hash", "serialized_size"), "xorb_hash").withColumn("shard", shard_of(F.col("xorb_hash")))
    shards = op.build_shards(files, chunks, created=1700000000)
    got = op.shard_segments(shards).select("shard", F.lower(F.hex("file_hash")).alias("file_hash"), "segment_index", "unpacked_segment_size", "chunk_index_start", "chunk_index_end")
    return got


def _one_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, index, xorbs = _conversation_tables(spark, sf_dir)
    files = segments.withColumn("file_hash", F.unhex(F.sha2(F.col("file_id").cast("string").cast("binary"), 256))).withColumn("shard", F.lit(0)).withColumn("range_hash", F.lit(None).cast("binary"))
    chunks = index.join(xorbs.select("xorb_hash", "serialized_size"), "xorb_hash").withColumn("shard", F.lit(0))
    return op.build_shards(files, chunks, key=bytes([77]) + bytes(31), created=1700000000, expires=1700086400)


def shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation tables into one shard and back: the xorb section."""
    return op.shard_chunks(_one_shard(spark, sf_dir)).select("chunk_index", "byte_range_start", "size", "serialized_size")


def shard_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = _one_shard(spark, sf_dir)
    f = op.shard_footer(F.col("payload"))
    return shards.select("shard", F.length("payload").alias("n_bytes"), f.alias("f")).select("shard", "n_bytes", "f.*")


def verify_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored turns that no longer have their hash: none."""
    units = _turn_chunks(spark, sf_dir, with_data=True)
    return op.verify_chunks(units).groupBy("role", "ok").agg(F.count(F.lit(1)).alias("chunks"))


# -- catalog -----------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a listing: entries of a namespace a top-level domain."""
    pages = _table(spark, sf_dir, "pages").filter("url is not null")
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    namespace = F.concat(F.lit("web/"), F.regexp_extract("url", r"^[a-z]+://[^/]*\.([a-z]+)/", 1))
    return pages.select("page_id", namespace.alias("namespace"), path.alias("path"), F.octet_length("html").cast("bigint").alias("size"), F.when(F.col("page_id") % 7 != 0, F.sha2(F.col("html").cast("binary"), 256)).alias("file_hash_hex"), F.when(F.col("page_id") % 11 == 0, "directory").otherwise("file").alias("type"))


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of JSON, a namespace each, read back as files."""
    entries = numbered(_entries(spark, sf_dir), ["page_id"])
    row = F.struct("ord", F.struct("type", "path", F.when(F.col("page_id") % 13 != 0, F.col("size")).alias("size"), F.col("file_hash_hex").alias("xetHash")).alias("e"))
    bodies = entries.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), F.to_json(row["e"]).alias("j")))).alias("rows"))
    bodies = bodies.select("namespace", F.concat(F.lit("["), F.array_join("rows.j", ","), F.lit("]")).alias("body"), F.lit(0).alias("page"))
    got = op.file_list(parse_listing(bodies))
    return got.select("path", "size", "file_hash_hex")


def find_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes of every path, looked up in list order."""
    files = op.file_list(_entries(spark, sf_dir).withColumn("ord", F.col("page_id")))
    names = _entries(spark, sf_dir).select(F.explode(F.array("path", F.element_at(F.split("path", "/"), -1), F.expr("right(path, 3)"))).alias("name")).filter("name <> ''").distinct()
    return op.find_file(files, names)


def next_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").filter("url is not null")
    rel = F.when(F.col("page_id") % 3 == 0, "prev").otherwise("next")
    header = F.concat(F.lit('<https://first.example/>; rel="first", <'), F.col("url"), F.lit('>; rel="'), rel, F.lit('"'))
    return pages.select("page_id", fn.next_link(header).alias("target"))


def register_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations of every page, the last of a path wins."""
    got = op.latest_entries(_entries(spark, sf_dir).withColumn("mtime", F.lit(0).cast("bigint")).withColumn("version", F.col("page_id")))
    return got.select("namespace", "path", "size", "file_hash_hex")


def registration_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration_lines(_entries(spark, sf_dir).filter("file_hash_hex is not null"))


def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path asked for in every second namespace too."""
    entries = _entries(spark, sf_dir)
    catalog = op.latest_entries(entries.withColumn("mtime", F.lit(0).cast("bigint")).withColumn("version", F.col("page_id")).withColumn("size", F.when(F.col("page_id") % 5 != 0, F.col("size"))))
    asked = entries.select("namespace", "path").union(entries.select(F.lit("web/none").alias("namespace"), "path")).distinct()
    return op.catalog_lookup(catalog, asked)


def ensure_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    known = entries.filter("namespace like '%com'").select("namespace")
    return op.ensure_namespace(known, entries.select("namespace"))


def put_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put by content into a store that has the benchmark's texts and
    the conversations'."""
    held = _table(spark, sf_dir, "benchmark").select("text").union(_table(spark, sf_dir, "conversations").select("text")).filter("text is not null")
    docs = _table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", fn.data_hash(F.col("text")).alias("chunk_hash"))
    got = op.put_if_absent(held.select(fn.data_hash(F.col("text")).alias("chunk_hash")), docs, "chunk_hash", ["doc_id"])
    return got.select("doc_id", "was_inserted")


def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 17 != 0, (F.lit(200) + F.col("event_id") % 310).cast("int"))
    got = _table(spark, sf_dir, "events").select(fn.error_class(status).alias("c"))
    return got.groupBy("c.error", "c.retryable").agg(F.count(F.lit(1)).alias("events"))


# -- streaming ---------------------------------------------------------------


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream of files, new chunks appended to a store."""
    path = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(path).schema
    source = path if len(spark.read.parquet(path).inputFiles()) > 1 else f"{sf_dir}/conversations*.parquet"
    turns = spark.readStream.schema(schema).parquet(source)
    files = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"), F.col("text").alias("content"))
    store = fresh_dir(spark, "stream-store")
    append_new_chunks(stream_chunks(files), store, fresh_dir(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(store).select(_sha(F.col("data")).alias("chunk_sha256"), "size")


ALL = [
    chunk_bounds, page_chunks, dedup_by_source, turn_dedup, new_vs_known, bundle_chunks, bundle_dedup, ultracdc_chunks,
    file_hashes, merkle_roots, merkle_cut, api_hex,
    xorb_pack, xorb_pack_raw, xorb_headers, xorb_roundtrip, xorb_range, chunk_read, codec_roundtrip, byte_groups, bit_slices, vector_codecs,
    turn_segments, fetch_plan, reconstruct_full, reconstruct_range, stream_pieces, lost_xorbs, spoiled_xorbs, xorb_parts, convert, compression_ratio, reconstruction_json,
    fetch_match, keyed_lookup, shard_roundtrip, shard_index, shard_footers, verify_store,
    list_files, find_file, next_link, register_files, registration_ndjson, catalog_lookup, ensure_namespace, put_if_absent, error_class,
    stream_dedup,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
