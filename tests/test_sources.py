"""Formats on disk, JSON plans, and SQL registration."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnspark import functions as fn
from cairnspark import operators as op
from cairnspark import sources
from cairnspark.kernels import bits
from cairnspark.plans import ingest

from .test_kernels import splitmix

CONTENT = {"a": splitmix(150_000, 8), "b": b"text " * 9000}


@pytest.fixture(scope="module")
def done(spark):
    files = spark.createDataFrame(list(CONTENT.items()), "file_id string, content binary")
    return ingest(files, codec="lz4", cap=40_000, least=512, most=4096, bits=9)


def test_xorb_files(spark, done, tmp_path):
    path = f"{tmp_path}/xorbs"
    sources.write_blobs(done.xorbs.select("xorb_hash", "payload"), path)
    want = op.read_xorb(done.xorbs).agg(F.count("*"), F.sum("size"), F.sum(F.hash("data"))).first()
    for rows in (spark.read.format("xorb").load(path), sources.read_xorbs(spark, path)):
        assert rows.agg(F.count("*"), F.sum("size"), F.sum(F.hash("data"))).first() == want
    third = spark.read.format("xorb").load(path).filter("chunk_index = 2")
    assert third.count() == done.xorbs.filter("chunk_count > 2").count()
    assert sources.read_files(spark, path).count() == done.xorbs.count()


def test_shard_files(spark, done, tmp_path):
    hashes = done.hashes.select("file_id", "file_hash")
    segs = done.segments.join(hashes, "file_id").withColumn("shard", F.lit(0)).withColumn("range_hash", F.lit(None).cast("binary"))
    chunks = done.xorb_chunks.join(done.xorbs.select("xorb_hash", "serialized_size"), "xorb_hash").withColumn("shard", F.lit(0))
    shards = op.build_shards(segs, chunks)
    path = f"{tmp_path}/shards"
    sources.write_blobs(shards.select(F.unhex(F.sha2("payload", 256)).alias("name"), "payload"), path, "shard")
    assert spark.read.format("shard").load(path).count() == chunks.count() == sources.read_shards(spark, path).count()
    assert sources.read_shards(spark, path, "files").count() == segs.count()


def test_missing_folder_is_empty(spark, tmp_path):
    sources.register_formats(spark)
    assert spark.read.format("xorb").load(f"{tmp_path}/none").count() == 0


def test_gear_table_file(spark, tmp_path):
    (tmp_path / "table.txt").write_text("\n".join(f"{i * i + 1:016x}" for i in range(256)))
    table = sources.read_gear_table(spark, f"file://{tmp_path}/table.txt")
    files = spark.createDataFrame(list(CONTENT.items()), "file_id string, content binary")
    sizes = [op.chunk_files(files, table=t, least=512, most=4096, bits=9).count() for t in (None, table)]
    assert sizes[0] != sizes[1]


HASH = "00" * 31 + "01"
ANSWER = '{"offset_into_first_range": 42, "terms": [{"hash": "%s", "unpacked_length": 1000, "range": {"start": 0, "end": 5}}], "fetch_info": {"%s": [{"range": {"start": 0, "end": 5}, "url": "u", "url_range": {"start": 0, "end": 999}}]}}' % (HASH, HASH)


def test_reconstruction_answers(spark):
    rows = [(1, ANSWER), (2, '{"terms": []}'), (3, None)]
    df = spark.createDataFrame(rows, "file_id int, body string").select("file_id", sources.parse_reconstruction(F.col("body")).alias("plan"))
    plans = {r.file_id: r.plan for r in df.collect()}
    assert plans[1].offset_into_first_range == 42 and plans[2].offset_into_first_range == 0 and plans[2].fetch_info == {} and plans[3] is None
    term = sources.terms_of(df).first()
    assert (term.unpacked_length, term.range_start, term.range_end) == (1000, 0, 5)
    info = sources.fetch_infos(df).first()
    assert (info.url, info.url_start, info.url_end, info.xorb_hash) == ("u", 0, 999, term.xorb_hash)
    bad = spark.createDataFrame([("{}",), ("junk",), (ANSWER.replace("00", "zz", 1),)], "body string")
    assert [r[0] for r in bad.select(sources.parse_reconstruction(F.col("body"), strict=False)).collect()] == [None] * 3
    for r in bad.collect():
        with pytest.raises(PySparkException, match="InvalidResponse"):
            spark.createDataFrame([r], "body string").select(sources.parse_reconstruction(F.col("body"))).collect()


def test_listing(spark):
    pages = spark.createDataFrame([(1, '[{"type": "file", "path": "b"}]'), (0, '[{"type": "directory", "path": "d"}, {"type": "file", "path": "a", "size": 3, "xetHash": "h"}]')], "page int, body string")
    got = op.file_list(sources.parse_listing(pages)).orderBy("ord").collect()
    assert [(r.path, r.size, r.file_hash_hex) for r in got] == [("a", 3, "h"), ("b", 0, None)]


def test_links_and_errors(spark):
    df = spark.createDataFrame([('<https://x/1>; rel="prev", <https://x/2>; rel="next"',), ('<https://x/1>; rel="prev"',), (None,)], "h string")
    assert [r[0] for r in df.select(fn.next_link(F.col("h"))).collect()] == ["https://x/2", None, None]
    codes = spark.createDataFrame([(s,) for s in (429, 500, 503, 504, None, 400, 401, 403, 404, 416, 200)], "s int")
    got = codes.select(fn.error_class(F.col("s")).alias("c")).select("c.*").collect()
    assert [r.retryable for r in got] == [True] * 5 + [False] * 6
    assert got[-1].error is None


def test_sql_functions(spark):
    fn.register(spark)
    got = spark.sql("SELECT hex(cas_bg4(cast('abcdefgh' AS binary))) g, cas_bg4_inverse(cas_bg4(cast('abcde' AS binary))) b, cas_chunk_bounds(cast('xyz' AS binary)) c, length(cas_data_hash(cast('x' AS binary))) n").first()
    assert got.g == bits.group4(b"abcdefgh").hex().upper() and bytes(got.b) == b"abcde" and got.c == [3] and got.n == 32


@pytest.mark.parametrize("algorithm", ["gearhash", "ultracdc"])
@pytest.mark.parametrize("block", [10_000, 65_536, 1 << 26])
def test_large_files_in_blocks(spark, tmp_path, algorithm, block):
    kinds = {"a": splitmix(500_000, 9), "deep/zeros": bytes(300_001), "b": b"x" * 70, "empty": b"", "c": splitmix(66_000, 2)}
    for k, v in kinds.items():
        (tmp_path / k).parent.mkdir(exist_ok=True)
        (tmp_path / k).write_bytes(v)
    small = {"least": 512, "most": 4096, "bits": 9}
    got = sources.chunk_large_files(spark, f"file://{tmp_path}", algorithm=algorithm, block=block, **small)
    want = op.chunk_files(sources.read_files(spark, f"file://{tmp_path}"), algorithm=algorithm, **small)
    rows = lambda df: sorted((r.file_id.split(":")[1].lstrip("/"), *map(str, r[1:])) for r in df.collect())
    assert got.columns == want.columns and rows(got) == rows(want)


def test_parts_of_xorbs(spark, done, tmp_path):
    sources.write_blobs(done.xorbs.select("xorb_hash", "payload"), str(tmp_path))
    plan = op.fetch_plan(done.segments, done.xorb_chunks)
    name = F.concat(F.lit(f"file://{tmp_path}/"), fn.api_hex(F.col("xorb_hash")), F.lit(".xorb"))
    got = sources.read_xorb_ranges(plan.withColumn("path", name)).collect()
    whole = {(r.path.split("/")[-1], r.chunk_index): bytes(r.data) for r in sources.read_xorbs(spark, str(tmp_path)).collect()}
    assert got and all(whole[r.path.split("/")[-1], r.chunk_index] == bytes(r.data) and r["size"] == len(r.data) for r in got)
    terms = {(r.path.split("/")[-1], r.range_start, r.range_end) for r in plan.withColumn("path", name).collect()}
    assert {(r.path.split("/")[-1], r.range_start, r.chunk_index) for r in got} == {(p, a, k) for p, a, b in terms for k in range(a, b)}
