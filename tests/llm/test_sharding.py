"""Op 6: one row a document, near-equal bytes, gapless slots."""

import zlib
from collections import defaultdict

from cairnspark.llm import kd_sharding as kd


def check(df, n, balanced=True):
    rows = df.collect()
    got = kd.kd_shards(df, n_shards=n).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r["size"], r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        by_slot = sorted(s, key=lambda r: r.slot)
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in by_slot]
        assert ids == sorted(ids)
    if balanced:
        size = [sum(r["size"] for r in shards[s]) for s in range(n)]
        mean, largest = sum(size) / n, max(r["size"] for r in got)
        assert max(abs(x - mean) for x in size) <= 2 * largest


def test_tables(docs, odd_docs, no_docs):
    check(docs, 3)
    check(docs, 24, balanced=False)
    check(odd_docs, 4, balanced=False)
    assert kd.kd_shards(no_docs).count() == 0


def test_real(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 24)


def test_hot_source_is_cut_through(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'same text' as text", "case when id % 3 = 0 then concat('s', id) else 'hot' end as source")
    check(df, 7)


def test_target_bytes(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "repeat('x', 92) as text")
    got = kd.kd_shards(df, n_shards=None, target_bytes=10_000).groupBy("shard").sum("size").collect()
    assert len(got) == 10 and all(abs(r[1] - 10_000) <= 200 for r in got)


def brute_force(rows, shards):
    """(doc_id, size, crc) -> shard by sorting each node's rows, one at a time."""
    out, root = [], [max(1, max(r[f"d{i}"] for r in rows) - min(r[f"d{i}"] for r in rows)) for i in range(4)]

    def split(rows, first, shards):
        if shards == 1 or not rows:
            out.extend(((r.doc_id, r["size"], r.text_crc32), first) for r in rows)
            return
        lo, hi = [min(r[f"d{i}"] for r in rows) for i in range(4)], [max(r[f"d{i}"] for r in rows) for i in range(4)]
        dim = max(range(4), key=lambda i: ((hi[i] - lo[i]) / root[i], -i))
        most = (1 << kd.DIM_BITS) - 1

        def key(r):
            return min(most, int((r[f"d{dim}"] - lo[dim]) * (most / max(1, hi[dim] - lo[dim])))), r.tie

        keys, want, before = defaultdict(int), sum(r["size"] for r in rows) * (shards // 2) / shards, 0
        for r in rows:
            keys[key(r)] += r["size"]
        for cut in sorted(keys):
            if before + keys[cut] > want:
                break
            before += keys[cut]
        with_it = before + keys[cut] / 2 <= want
        left = [r for r in rows if key(r) < cut or with_it and key(r) == cut]
        ids = set(map(id, left))
        split(left, first, shards // 2)
        split([r for r in rows if id(r) not in ids], first + shards // 2, shards - shards // 2)

    split(rows, 0, shards)
    return sorted(out, key=str)


def test_tree_matches_brute_force(spark, docs):
    for df, n in ((docs, 5), (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 24)):
        meta = kd._prepared(df, "doc_id", "text", ("source", "lang")).collect()
        got = sorted((((r.doc_id, r["size"], r.text_crc32), r.shard) for r in kd.kd_shards(df, n_shards=n).collect()), key=str)
        assert got == brute_force(meta, n)


def test_ids_of_64_bits(spark):
    ends = [-(2**63), 2**63 - 1, None, 0]
    df = spark.createDataFrame([(i, "x" * 50) for i in ends], "doc_id bigint, text string")
    df = df.union(spark.range(400).selectExpr("xxhash64(id) as doc_id", "repeat('y', 92) as text"))
    check(df, 7)
