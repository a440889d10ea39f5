"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, best_fit, cross_parsing, iblt, kd_sharding, line_dedup, simhash, simple8b, warc_fixity, winnowing
from .common import materialize, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.version_fingerprints(_table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page of a replica set with its verdict: the replica has suffered
    bit rot (see ``decayed``), which the audit has to locate."""
    records = materialize(warc_fixity.inventory(_table(spark, sf_dir, "pages"), replica=warc_fixity.decayed), "warc-records")
    replica = records.drop("digest").withColumnRenamed("copied", "digest")
    faults = materialize(warc_fixity.audit(records.drop("copied"), replica), "warc-faults")
    found = faults.select("file", F.col("idx").alias("seq"), "fault")
    return records.join(found, ["file", "seq"], "left").select("page_id", "length", F.coalesce("fault", F.lit("ok")).alias("verdict"))


def op3_cross_parsing_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cross_parsing.predict(docs, cross_parsing.sample(docs))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    simple8b.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return simple8b.read_tokens(spark, path)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.kd_shards(_table(spark, sf_dir, "documents"), n_shards=24)


def op7_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return attribution.section_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("bigint").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = [
        op1_iblt_fingerprint,
        op2_warc_fixity,
        op3_cross_parsing_langid,
        op4_simple8b,
        op5_best_fit,
        op6_kd_shards,
        op7_simhash_popcount,
        op8_offset_attribution,
        op9_line_dedup,
        op10_winnowing,
        pipeline,
    ]
    return {f.__name__: f for f in fns}


_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: Bit rot hits pages whose id's CRC-32 is a multiple of 97, wherever it is
#: found; the CRC is folded over the digits by a recursive query.
OP2_SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT page_id, CAST(page_id AS VARCHAR) AS s FROM pages WHERE page_id IS NOT NULL),
fold AS (
  SELECT page_id, s, 0 AS k, CAST(4294967295 AS BIGINT) AS c, 0 AS bit FROM ids
  UNION ALL
  SELECT page_id, s,
    CASE WHEN bit = 7 THEN k + 1 ELSE k END,
    CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END,
    (bit + 1) % 8
  FROM (SELECT *, CASE WHEN bit = 0 THEN xor(c, CAST(ascii(s[k + 1]) AS BIGINT)) ELSE c END AS x FROM fold WHERE k < length(s))
),
crc AS (SELECT page_id, xor(c, CAST(4294967295 AS BIGINT)) AS crc FROM fold WHERE k = length(s))
SELECT p.page_id,
  CAST(strlen('WARC/1.0__WARC-Type: response__WARC-Target-URI: ' || coalesce(url, '') || '__Content-Type: application/http; msgtype=response__Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || '____') + strlen(coalesce(html, '')) + 4 AS BIGINT) AS length,
  CASE WHEN crc % 97 = 0 THEN 'content' ELSE 'ok' END AS verdict
FROM pages p LEFT JOIN crc USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_fixity": OP2_SQL, "op10_winnowing": OP10_SQL}
