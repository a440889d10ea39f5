"""Operators on small frames: edge cases, errors, and whole round trips."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnspark import constants as c
from cairnspark import functions as fn
from cairnspark import operators as op
from cairnspark.kernels import merkle
from cairnspark.kernels.blake3 import keyed
from cairnspark.plans import Store, convert_stats, ingest
from cairnspark.streaming import ProgressListener, append_new_chunks, distinct_chunks, stream_chunks, with_progress

from .test_kernels import ROOTS, leaves, splitmix

FILES = {"a": splitmix(300_000, 1), "b": splitmix(300_000, 1)[:200_000] + splitmix(90_000, 2), "c": b"tiny", "d": b"", "e": None, "f": bytes(400_000)}
SMALL = {"least": 512, "most": 4096, "bits": 9}


@pytest.fixture(scope="module")
def files(spark):
    """Contents of all kinds, with columns whose names clash with inner ones."""
    rows = [(k, v, i, "x") for i, (k, v) in enumerate(FILES.items())]
    return spark.createDataFrame(rows, "file_id string, content binary, chunk_index int, data string")


def test_chunks_tile_and_hash(files):
    got = {}
    for r in op.chunk_files(files, **SMALL).orderBy("file_id", "chunk_index").collect():
        got.setdefault(r.file_id, []).append(r)
    assert set(got) == {"a", "b", "c", "f"}
    for k, rows in got.items():
        assert b"".join(bytes(r.data) for r in rows) == FILES[k]
        assert [r.chunk_index for r in rows] == list(range(len(rows)))
        assert keyed(c.DATA_KEY, [bytes(r.data) for r in rows]) == [bytes(r.chunk_hash) for r in rows]


def test_no_files(spark):
    none = spark.createDataFrame([], "file_id string, content binary")
    chunks = op.chunk_files(none)
    assert chunks.count() == 0 and op.file_hashes(chunks, none).count() == 0
    done = ingest(none)
    assert done.xorbs.count() == 0 and done.segments.count() == 0
    assert op.chunk_stats(op.mark_duplicates(chunks)).first().asDict() == {"chunks": 0, "unique_chunks": 0, "raw_bytes": 0, "unique_bytes": 0, "dedup_savings": 0, "savings_pct": 0.0}


def test_dedup_counts(files):
    chunks = op.chunk_files(files, with_data=False, **SMALL)
    rows = sorted((r.file_id, r.chunk_index, bytes(r.chunk_hash), r.size) for r in chunks.collect())
    first, saved = {}, 0
    for i, k, h, n in rows:
        saved += n if h in first else 0
        first.setdefault(h, (i, k))
    got = op.chunk_stats(op.mark_duplicates(chunks)).first()
    assert (got.chunks, got.unique_chunks, got.dedup_savings) == (len(rows), len(first), saved)
    assert saved > 200_000
    assert {bytes(r.chunk_hash): tuple(r["first"]) for r in op.first_occurrences(chunks).collect()} == first


def test_pack_files(spark):
    rows = spark.createDataFrame([("a", 2, "two"), ("a", 1, "öne"), ("b", 1, None)], "g string, o int, t string")
    got = {r.g: bytes(r.content) for r in op.pack_files(rows, ["g"], "o", "t").collect()}
    assert got == {"a": "önetwo".encode(), "b": b""}


def test_published_tree_roots(spark):
    rows = [(k, i, h, n) for k in ROOTS for i, (h, n) in enumerate(leaves(k))]
    nodes = spark.createDataFrame(rows, "file_id string, chunk_index int, chunk_hash binary, size bigint")
    got = {r.file_id: merkle.api_hex(bytes(r.root)) for r in op.tree_roots(nodes).collect()}
    assert got == {k: v for k, v in ROOTS.items() if k}


def test_roots_do_not_depend_on_batches(spark):
    nodes = {k: [(splitmix(32, 1000 * i + j), j) for j in range(n)] for i, (k, n) in enumerate({"p": 700, "q": 1, "r": 95, "s": 9}.items())}
    df = spark.createDataFrame([(k, j, h, s) for k, v in nodes.items() for j, (h, s) in enumerate(v)], "file_id string, chunk_index int, chunk_hash binary, size bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.file_id: bytes(r.root) for r in op.tree_roots(df).collect()}
        packed = {(r.file_id, r.chunk_index): r.xorb_index for r in op.assign_xorbs(df.withColumn("size", F.lit(10)), cap=180).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: merkle.roots([v])[0] for k, v in nodes.items()}
    assert packed == {(k, j): j // 10 for k, v in nodes.items() for j in range(len(v))}


def test_file_hashes_with_empty_files(files):
    chunks = op.chunk_files(files, with_data=False)
    got = {r.file_id: (bytes(r.file_hash), r.file_size) for r in op.file_hashes(chunks, files).collect()}
    assert got["d"] == got["e"] == (c.ZERO, 0)
    root = keyed(c.DATA_KEY, [b"tiny"])
    assert got["c"] == (keyed(c.ZERO, root)[0], 4)


@pytest.mark.parametrize("cap,overhead,sizes,want", [(100, 8, [40, 40, 40], [0, 0, 1]), (96, 8, [40, 40], [0, 0]), (95, 8, [40, 40], [0, 1]), (80, 0, [40, 40, 1], [0, 0, 1]), (10, 8, [50, 1, 50], [0, 1, 2]), (18, 8, [1, 1, 1], [0, 0, 1])])
def test_greedy_packing(spark, cap, overhead, sizes, want):
    df = spark.createDataFrame([("f", i, bytes([i]), n) for i, n in enumerate(sizes)], "file_id string, chunk_index int, chunk_hash binary, size bigint")
    got = op.assign_xorbs(df, cap, overhead).orderBy("chunk_index").collect()
    assert [r.xorb_index for r in got] == want


@pytest.mark.parametrize("rows", [2, 10_000])
def test_small_xorbs_are_built_many_at_a_time(spark, rows):
    """No call into Python a xorb; batches may cut xorbs anywhere."""
    from cairnspark.kernels.codec import serialize_xorb

    units = {f"f{k}": [splitmix(50 + 7 * i, 40 * k + i) for i in range(1 + k % 6)] for k in range(40)}
    flat = [(f, i, keyed(c.DATA_KEY, [d])[0], len(d), d) for f, ds in units.items() for i, d in enumerate(ds)]
    data = spark.createDataFrame(flat, "file_id string, chunk_index int, chunk_hash binary, size bigint, data binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        xorbs = op.build_xorbs(op.assign_xorbs(data.drop("data"), cap=200), data, "lz4")
        got = {(r.file_id, r.xorb_index): r for r in xorbs.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in xorbs._jdf.queryExecution().executedPlan().toString()
    want = {}
    for f, ds in units.items():
        xorb, held = 0, []
        for d in ds:
            if held and sum(len(x) + 8 for x in [*held, d]) > 200:
                xorb, held = xorb + 1, []
            held = [*held, d]
            want[f, xorb] = held
    assert set(got) == set(want) and len(got) > 60
    for k, ds in want.items():
        r, (payload, spans), hashes = got[k], serialize_xorb(ds), keyed(c.DATA_KEY, ds)
        assert bytes(r.payload) == payload and r.serialized_size == len(payload) and r.total_raw_bytes == sum(map(len, ds))
        assert bytes(r.xorb_hash) == merkle.roots([list(zip(hashes, map(len, ds), strict=True))])[0] and r.chunk_count == len(ds)
        at = [sum(map(len, ds[:i])) for i in range(len(ds))]
        assert [(x.chunk_index, bytes(x.chunk_hash), x.byte_range_start, x.size, x.ser_start, x.ser_end) for x in r.chunks] == [(i, h, at[i], len(d), *spans[i]) for i, (h, d) in enumerate(zip(hashes, ds, strict=True))]


@pytest.mark.parametrize("codec", c.CODECS)
def test_ingest_and_reconstruct(files, codec):
    done = ingest(files, codec=codec, cap=50_000, **SMALL)
    tables = (done.segments.cache(), done.xorb_chunks.cache(), done.xorbs.cache())
    got = {r.file_id: bytes(r.content) for r in op.reconstruct(*tables).collect()}
    assert got == {k: v for k, v in FILES.items() if v}
    assert tables[2].agg(F.max("serialized_size")).first()[0] <= 50_000
    spans = [("a", 0, 10), ("a", 1000, 250_000), ("b", 0, 0), ("b", 289_999, 290_000), ("c", 1, 3), ("f", 0, 400_000)]
    ranges = files.sparkSession.createDataFrame(spans[:2][1:] + spans[2:3] + spans[4:], "file_id string, range_start bigint, range_end bigint")
    got = {r.file_id: bytes(r.content) for r in op.reconstruct_range(*tables, ranges).collect()}
    assert got == {"a": FILES["a"][1000:250_000], "b": b"", "c": b"in", "f": FILES["f"]}
    beyond = ranges.filter("file_id = 'c'").withColumn("range_end", F.lit(9))
    assert op.reconstruct_range(*tables, beyond, strict=False).first().error == "SizeMismatch"
    with pytest.raises(PySparkException, match="SizeMismatch"):
        op.reconstruct_range(*tables, beyond).collect()
    pieces = op.reconstruct_stream(*tables).filter("file_id = 'b'").collect()
    assert b"".join(bytes(r.data) for r in pieces) == FILES["b"]


def test_flipped_byte_is_found(files):
    done = ingest(files, cap=50_000, codec="none", **SMALL)
    broken = done.xorbs.withColumn("payload", F.when(F.col("file_id") == "c", F.concat(F.substring("payload", 1, 8), F.lit(b"Tiny"))).otherwise(F.col("payload")))
    got = {r.file_id: (r.error, r.content) for r in op.reconstruct(done.segments, done.xorb_chunks, broken, strict=False).collect()}
    assert {k: e for k, (e, _) in got.items()} == {"a": None, "b": None, "c": "HashMismatch", "f": None} and got["c"][1] is None
    with pytest.raises(PySparkException, match="HashMismatch"):
        op.reconstruct(done.segments, done.xorb_chunks, broken).collect()
    assert op.reconstruct(done.segments, done.xorb_chunks, broken, verify=False).filter("file_id = 'c'").first().content == b"Tiny"


def test_a_range_decodes_its_chunks_alone(files):
    """Chunks beside the range may be unreadable."""
    done = ingest(files.filter("file_id = 'a'"), codec="lz4", **SMALL)
    index = done.xorb_chunks.orderBy("chunk_index").collect()
    hit = index[3]
    stored = bytes(done.xorbs.first().payload)
    heads = b"".join(stored[x.ser_start : x.ser_start + 8] + bytes(x.ser_end - x.ser_start - 8) for x in index[:3])
    spoiled = done.xorbs.withColumn("payload", F.concat(F.lit(heads), F.expr(f"substring(payload, {hit.ser_start + 1})")))
    ranges = files.sparkSession.createDataFrame([("a", hit.byte_range_start + 1, hit.byte_range_start + 9)], "file_id string, range_start bigint, range_end bigint")
    assert op.reconstruct_range(done.segments, done.xorb_chunks, spoiled, ranges).first().content == FILES["a"][hit.byte_range_start + 1 : hit.byte_range_start + 9]
    with pytest.raises(PySparkException):
        op.reconstruct(done.segments, done.xorb_chunks, spoiled).collect()


def test_lost_xorb_fails_its_files_alone(files):
    done = ingest(files, cap=50_000, **SMALL)
    xorbs = done.xorbs.filter("file_id <> 'f'")
    got = {r.file_id: r.error for r in op.reconstruct(done.segments, done.xorb_chunks, xorbs, strict=False).collect()}
    assert got == {"a": None, "b": None, "c": None, "f": "SizeMismatch"}


def test_without_dedup(files):
    done = ingest(files, codec="none", dedup=False, **SMALL)
    raw = done.xorbs.agg(F.sum("total_raw_bytes")).first()[0]
    assert raw == sum(len(v or b"") for v in FILES.values())
    stats = {r.file_id: r for r in convert_stats(files, ingest(files, codec="none", **SMALL)).collect()}
    assert stats["d"].file_size == 0 and stats["d"].compression_pct == 0.0 and stats["f"].dedup_savings > 300_000


def test_xorb_reader_modes(spark):
    from cairnspark.kernels.codec import serialize_xorb

    raw, _ = serialize_xorb([b"one", b"two" * 99], "lz4")
    df = spark.createDataFrame([("good", raw), ("cut", raw[:-3]), ("none", None), ("empty", b"")], "xorb_hash string, payload binary")
    rows = op.read_xorb(df, strict=False).collect()
    assert [(r.xorb_hash, r.chunk_index, r.error) for r in sorted(rows, key=lambda r: (r[0], r.error or ""))] == [("cut", 0, None), ("cut", None, "TruncatedXorb"), ("good", 0, None), ("good", 1, None)]
    with pytest.raises(PySparkException, match="TruncatedXorb"):
        op.read_xorb(df).collect()
    assert bytes(op.read_chunk(df.filter("xorb_hash = 'good'"), 1).first().data) == b"two" * 99
    assert {r.xorb_hash: r.error for r in op.read_chunk(df, 1, strict=False).collect()} == {"good": None, "cut": "TruncatedXorb", "none": None, "empty": "ChunkNotFound"}
    with pytest.raises(PySparkException, match="ChunkNotFound"):
        op.read_chunk(df.filter("xorb_hash = 'good'"), 2).collect()
    ranged = df.withColumn("r", op.extract_range(F.col("payload"), F.lit(0), F.lit(2), strict=False)).select("xorb_hash", "r.*")
    assert {r.xorb_hash: r.error for r in ranged.collect()} == {"good": None, "cut": "TruncatedXorb", "none": None, "empty": "RangeOutOfBounds"}


def test_shards(spark):
    segs = spark.createDataFrame([(1, b"f" * 32, 0, b"x" * 32, 1000, 0, 5, b"r" * 32), (1, b"f" * 32, 1, b"y" * 32, 10, 2, 3, b"r" * 32), (2, b"g" * 32, 0, b"x" * 32, 7, 0, 1, None)], "shard int, file_hash binary, segment_index int, xorb_hash binary, unpacked_segment_size bigint, chunk_index_start int, chunk_index_end int, range_hash binary")
    chunks = spark.createDataFrame([(1, b"x" * 32, i, bytes([i]) * 32, s, n, 15000) for i, (s, n) in enumerate([(0, 8192), (8192, 16384), (24576, 4096)])], "shard int, xorb_hash binary, chunk_index int, chunk_hash binary, byte_range_start bigint, size bigint, serialized_size bigint")
    key = bytes(7 * i % 256 for i in range(32))
    shards = op.build_shards(segs, chunks, key=key, created=1700000000).cache()
    back = op.shard_segments(shards).select(segs.columns)
    assert sorted(back.collect(), key=str) == sorted(segs.collect(), key=str)
    assert sorted(op.shard_chunks(shards).select(chunks.columns).collect(), key=str) == sorted(chunks.collect(), key=str)
    f = shards.filter("shard = 1").select(op.shard_footer(F.col("payload")).alias("f")).select("f.*").first()
    assert f.is_keyed and bytes(f.chunk_hash_key) == key and f.expires is None and f.created is not None
    plain = op.build_shards(segs, chunks).filter("shard = 2").select(op.shard_footer(F.col("payload")).alias("f")).select("f.*").first()
    assert not plain.is_keyed and plain.chunk_hash_key is None and plain.created is None


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_shards_are_folded_as_rows_arrive(spark, rows):
    """No table of a shard's rows is made in Python; batches may cut files,
    xorbs and shards anywhere, and bytes are those of the plain writer."""
    from cairnspark.kernels.codec import FileInfo, Shard, XorbInfo, shard_layout

    h = lambda *x: keyed(c.ZERO, [repr(x).encode()])[0]
    files = {(s, h("f", s, f)): ([(h("x", f, k), 2**31 + k, k, 2**20 + k) for k in range(1 + f % 4)], h("r", f) if f % 3 == 1 else None) for s in (None, 1, 2) for f in range(7)}
    xorbs = {(s, h("x", s, x)): ([(h("c", x, k), 9 * k, 2**30 + k) for k in range(1 + x % 3)], 77 + x) for s in (None, 2, 3) for x in range(5)}
    segs = spark.createDataFrame([(s, f, k, *seg, r) for (s, f), (own, r) in files.items() for k, seg in enumerate(own)], "shard int, file_hash binary, segment_index int, xorb_hash binary, unpacked_segment_size bigint, chunk_index_start int, chunk_index_end int, range_hash binary")
    chunks = spark.createDataFrame([(s, x, k, *own, n) for (s, x), (all_own, n) in xorbs.items() for k, own in enumerate(all_own)], "shard int, xorb_hash binary, chunk_index int, chunk_hash binary, byte_range_start bigint, size bigint, serialized_size bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        shards = op.build_shards(segs, chunks, created=5)
        got = {r.shard: bytes(r.payload) for r in shards.collect()}
        back = [sorted(map(tuple, f(shards).select(x.columns).collect()), key=repr) == sorted(map(tuple, x.collect()), key=repr) for f, x in ((op.shard_segments, segs), (op.shard_chunks, chunks))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert back == [True, True] and "CoGroups" not in shards._jdf.queryExecution().executedPlan().toString()
    assert set(got) == {None, 1, 2, 3}
    for s, payload in got.items():
        own_files = [FileInfo(f, own, r) for (k, f), (own, r) in sorted(files.items(), key=lambda x: x[0][1]) if k == s]
        own_xorbs = [XorbInfo(x, own, sum(n for *_, n in own), stored) for (k, x), (own, stored) in sorted(xorbs.items(), key=lambda x: x[0][1]) if k == s]
        assert payload == Shard(own_files, own_xorbs, created=5).to_bytes()
        parts = shard_layout(payload)
        assert sum(len(x[0]) for x in parts.segments(2)) == sum(len(f.segments) for f in own_files)
        assert [x for p in parts.chunks(2) for x in p[3].tolist()] == [list(h) for x in own_xorbs for h, *_ in x.chunks]
    big = segs.withColumn("unpacked_segment_size", F.lit(2**32))
    with pytest.raises(PySparkException, match="32 bits"):
        op.build_shards(big, chunks).collect()


def test_keyed_lookup(spark):
    probes = spark.createDataFrame([(bytes([i]) * 32,) for i in range(4)], "chunk_hash binary")
    key = bytes([77]) + bytes(31)
    stored = keyed(key, [bytes([1]) * 32])[0]
    index = spark.createDataFrame([("s", 5, stored, 100), ("s", 3, stored, 200), ("u", 0, bytes([2]) * 32, 300)], "shard string, position bigint, chunk_hash binary, offset bigint")
    keys = spark.createDataFrame([("s", key), ("u", bytes(32))], "shard string, key binary")
    got = {bytes(r.chunk_hash)[0]: r.place and (r.place.shard, r.place.position, r.place.offset) for r in op.lookup_chunks(probes, index, keys).collect()}
    assert got == {0: None, 1: ("s", 3, 200), 2: ("u", 0, 300), 3: None}
    plain = {bytes(r.chunk_hash)[0]: r.place is not None for r in op.lookup_chunks(probes, index).collect()}
    assert plain == {0: False, 1: False, 2: True, 3: False}


def test_keyed_lookup_of_many_keys(spark):
    keys = [(f"s{i:04}", i.to_bytes(32, "big")) for i in range(1002)]
    probes = spark.createDataFrame([(b"a" * 32,), (b"b" * 32,)], "chunk_hash binary")
    index = spark.createDataFrame([(s, 1, keyed(k, [b"a" * 32])[0]) for s, k in keys[500:]], "shard string, position bigint, chunk_hash binary")
    got = op.lookup_chunks(probes, index, spark.createDataFrame(keys, "shard string, key binary"))
    assert {bytes(r.chunk_hash): r.place and (r.place.shard, r.place.position) for r in got.collect()} == {b"a" * 32: ("s0500", 1), b"b" * 32: None}


def test_fetch_match(spark):
    terms = spark.createDataFrame([("f", 0, "x", 2, 4), ("f", 1, "x", 0, 9), ("g", 0, "z", 0, 1)], "file_id string, term_index int, xorb_hash string, range_start int, range_end int")
    infos = spark.createDataFrame([("x", 1, 0, 5, "late", 0, 9), ("x", 0, 1, 4, "first", 0, 9)], "xorb_hash string, position int, info_start int, info_end int, url string, url_start int, url_end int")
    got = {(r.file_id, r.term_index): (r.url, r.local_start, r.local_end, r.error) for r in op.match_fetch_ranges(terms, infos, strict=False).collect()}
    assert got == {("f", 0): ("first", 1, 3, None), ("f", 1): (None, None, None, "NoMatchingFetchInfo"), ("g", 0): (None, None, None, "MissingFetchInfo")}
    with pytest.raises(PySparkException, match="FetchInfo"):
        op.match_fetch_ranges(terms, infos).collect()


def test_equal_fetch_ranges_are_compared_once(spark):
    """A range that is listed any number of times costs a term one comparison,
    and the first by position still wins."""
    from cairnspark.operators.lookup import _ranges_by_xorb

    rows = [(b"x", p, p % 5, 5 + p % 5, f"u{p}", 0, 9) for p in range(999, -1, -1)] + [(b"y", None, 1, 2, "none", 0, 9), (b"y", 7, 1, 2, "seven", 0, 9)]
    infos = spark.createDataFrame(rows, "xorb_hash binary, position bigint, info_start bigint, info_end bigint, url string, url_start bigint, url_end bigint")
    assert {bytes(r.xorb_hash): [i.position for i in r.infos] for r in _ranges_by_xorb(infos).collect()} == {b"x": [0, 1, 2, 3, 4], b"y": [None]}
    terms = spark.createDataFrame([(k, 0, x, a, b) for k, (x, a, b) in enumerate([(b"x", 3, 8), (b"x", 0, 6), (b"y", 1, 2), (b"z", 0, 1), (None, 0, 1), (b"x", None, 4)])], "file_id int, term_index int, xorb_hash binary, range_start bigint, range_end bigint")
    got = {r.file_id: r.url or r.error for r in op.match_fetch_ranges(terms, infos, strict=False).collect()}
    assert got == {0: "u3", 1: "NoMatchingFetchInfo", 2: "none", 3: "MissingFetchInfo", 4: "MissingFetchInfo", 5: "NoMatchingFetchInfo"}


def test_hex_functions(spark):
    raw = [splitmix(32, i) for i in range(200)]
    df = spark.createDataFrame([(h,) for h in raw], "h binary").select("h", fn.api_hex(F.col("h")).alias("t"))
    rows = df.select("h", "t", fn.from_api_hex(F.col("t")).alias("b")).collect()
    assert all(r.t == merkle.api_hex(bytes(r.h)) and r.b == r.h for r in rows)
    bad = spark.createDataFrame([("123abc",), ("g" * 64,), (None,)], "t string")
    assert [r[0] for r in bad.select(fn.from_api_hex(F.col("t"), strict=False)).collect()] == [None] * 3
    with pytest.raises(PySparkException, match="InvalidHexLength"):
        bad.filter("length(t) = 6").select(fn.from_api_hex(F.col("t"))).collect()


def test_headers_and_groups(spark):
    from cairnspark.kernels import bits, codec

    sizes = [0, 1, 255, 256, 0x80D3, 65536, 16777215]
    df = spark.createDataFrame([(n, splitmix(n % 23, n)) for n in sizes], "n int, d binary")
    got = df.select("n", "d", fn.chunk_header(F.col("n"), fn.codec_code(F.lit("bg4")), F.col("n")).alias("h"), fn.byte_group(F.col("d")).alias("g")).collect()
    assert all(bytes(r.h) == codec.chunk_header(r.n, 2, r.n) and bytes(r.g) == bits.group4(bytes(r.d)) for r in got)
    with pytest.raises(PySparkException, match="InvalidChunkSize"):
        df.select(fn.chunk_header(F.lit(1 << 24), F.lit(0), F.lit(1))).collect()


def test_catalog(spark):
    files = spark.createDataFrame([(0, "x/model.bin", 5, "h0"), (1, "model.bin", 6, "h1"), (2, "deep/x/y.txt", 0, None)], "ord bigint, path string, size bigint, file_hash_hex string")
    names = spark.createDataFrame([("model.bin",), ("x/y.txt",), (".txt",), ("nope",), ("p/x/y.txt",)], "name string")
    got = {r.name: r.path for r in op.find_file(files, names).collect()}
    # an earlier suffix match beats a later exact one
    assert got == {"model.bin": "x/model.bin", "x/y.txt": "deep/x/y.txt", ".txt": "deep/x/y.txt", "nope": None, "p/x/y.txt": "deep/x/y.txt" if "deep/x/y.txt".endswith("p/x/y.txt") else None}
    store = spark.createDataFrame([("k1",)], "key string")
    rows = spark.createDataFrame([("k1", 0), ("k2", 1), ("k2", 2)], "key string, o int")
    assert {r.o: r.was_inserted for r in op.put_if_absent(store, rows, "key", ["o"]).collect()} == {0: False, 1: True, 2: False}
    twice = rows.union(rows).union(spark.createDataFrame([(None, 5), (None, 5)], rows.schema))
    assert sorted((r.o, r.was_inserted) for r in op.put_if_absent(store, twice, "key", ["o"]).collect()) == [(0, False), (0, False), (1, False), (1, True), (2, False), (2, False), (5, False), (5, True)]
    with pytest.raises(PySparkException, match="InvalidNamespace"):
        op.ensure_namespace(spark.createDataFrame([], "namespace string"), spark.createDataFrame([("plain",)], "namespace string")).collect()


def test_repeated_rows_are_new_once(files):
    chunks = op.chunk_files(files, with_data=False, **SMALL)
    one, two = op.chunk_stats(op.mark_duplicates(chunks)).first(), op.chunk_stats(op.mark_duplicates(chunks.union(chunks))).first()
    assert (two.unique_chunks, two.unique_bytes, two.chunks) == (one.unique_chunks, one.unique_bytes, 2 * one.chunks)


def test_find_file_matches_brute_force(spark):
    import itertools
    import random

    rng = random.Random(0)
    paths = ["/".join(rng.choice(["a", "ab", "b.c", "config.json", ""]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    names = sorted({p[rng.randint(0, len(p)) :] for p in paths for _ in range(4)} - {""}) + ["x/config.json", "/", "b/ab"]
    files = spark.createDataFrame([(i, p, i, None) for i, p in enumerate(paths)], "ord bigint, path string, size bigint, file_hash_hex string")
    got = {r.name: (r.path, r.size) for r in op.find_file(files, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {n: next(itertools.chain(((p, i) for i, p in enumerate(paths) if p.endswith(n)), [(None, None)])) for n in names}


def test_a_commit_that_dies_is_as_if_it_had_not_been(spark, files, tmp_path, monkeypatch):
    store, some = Store(spark, f"file://{tmp_path}/store"), files.filter("file_id in ('a', 'c', 'd')")
    append = Store._append
    for dies in ("xorbs", "xorb_chunks", "file_segments", "catalog"):

        def fails(self, name, commit, rows, dies=dies):
            append(self, name, commit, rows)
            if name == dies:
                raise RuntimeError("killed")

        monkeypatch.setattr(Store, "_append", fails)
        with pytest.raises(RuntimeError):
            store.put(some, "ns/one", **SMALL)
        assert all(store.table(t).count() == 0 for t in ("xorbs", "xorb_chunks", "file_segments", "catalog"))
    monkeypatch.setattr(Store, "_append", append)
    assert all(r.was_inserted for r in store.put(some, "ns/one", **SMALL).collect())
    wanted = store.names().filter("size > 0").select("file_hash")
    assert sorted(bytes(r.content) for r in store.get(wanted).collect()) == sorted([FILES["a"], FILES["c"]])


def test_store(spark, files, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = {r.file_id: r for r in store.put(files.filter("file_id <> 'b'"), "ns/one", cap=60_000, **SMALL).collect()}
    before = store.table("xorbs").count()
    again = store.put(files, "ns/one", version=1, cap=60_000, **SMALL)
    assert not again.filter("file_id = 'a'").first().was_inserted and first["a"].was_inserted
    stored = store.table("xorbs").agg(F.sum("total_raw_bytes")).first()[0]
    assert before < store.table("xorbs").count() and stored < 650_000
    names = {r.path: bytes(r.file_hash) for r in store.names().collect()}
    wanted = spark.createDataFrame([(names[k],) for k in ("a", "b", "f")], "file_hash binary")
    got = {bytes(r.file_hash): bytes(r.content) for r in store.get(wanted).collect()}
    assert got == {names[k]: FILES[k] for k in ("a", "b", "f")}
    part = store.get_range(wanted.limit(1).withColumn("range_start", F.lit(7)).withColumn("range_end", F.lit(1007)))
    assert bytes(part.first().content) == FILES["a"][7:1007]


def test_streaming(spark, files, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    files.filter("file_id in ('a', 'c')").coalesce(1).write.parquet(source)
    seen = []
    listener = ProgressListener(lambda done, total: seen.append((done, total)), 10**6)
    spark.streams.addListener(listener)

    def run(state="state"):
        rows = spark.readStream.schema(files.schema).parquet(source)
        append_new_chunks(with_progress(stream_chunks(rows, **SMALL)), store, f"{tmp_path}/{state}").awaitTermination()

    run()
    files.filter("file_id not in ('a', 'c')").coalesce(1).write.mode("append").parquet(source)
    run()
    run()  # nothing new
    run("another state")  # all files again, and the store has their chunks
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(listener)
    want = {bytes(r.chunk_hash) for r in op.chunk_files(files, with_data=False, **SMALL).collect()}
    got = [bytes(r.chunk_hash) for r in spark.read.parquet(store).select("chunk_hash").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert seen == sorted(seen)
    total = sum(len(v or b"") for v in FILES.values())
    assert seen[-1] == (2 * total, max(2 * total, 10**6))
    assert distinct_chunks(op.chunk_files(files, **SMALL)).count() == len(want)
