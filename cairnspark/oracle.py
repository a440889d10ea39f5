"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .constants import CUT_BITS, MAX_CHUNK, MIN_CHUNK
from .queries import PACK_CAP

TWO64 = "18446744073709551616::HUGEINT"


def _chunks(files: str) -> str:
    """CTEs up to ch(id, k, s, e, h): the chunks of ``files`` (id, b BLOB), h
    their SHA-256. The byte table follows the same rule; contents of at most
    the least size are one chunk, so only longer ones are hashed."""
    doubling, last = "", "g0"
    for i, m in enumerate((1, 2, 4, 8, 16, 32)):
        doubling += f"""
g{i + 1} AS (SELECT id, i, (v + coalesce(lag(v, {m}) OVER (PARTITION BY id ORDER BY i), 0) * {1 << m}::HUGEINT) % {TWO64} AS v FROM {last}),"""
        last = f"g{i + 1}"
    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT id, octet_length(b) AS n, hex(b) AS x FROM ({files}) WHERE octet_length(b) > 0),
tab AS MATERIALIZED (SELECT i AS c, ('0x' || sha256(unhex(printf('%02x', i)))[:16])::UBIGINT::HUGEINT AS v FROM range(256) t(i)),
bt AS (SELECT id, i, ('0x' || x[2 * i + 1 : 2 * i + 2])::INT AS c FROM (SELECT id, x, unnest(range(n)) AS i FROM f WHERE n > {MIN_CHUNK})),
g0 AS (SELECT id, i, v FROM bt JOIN tab USING (c)),{doubling}
cand AS MATERIALIZED (SELECT id, i + 1 AS pos FROM {last} WHERE v // {1 << (64 - CUT_BITS)}::HUGEINT = 0),
cuts AS (
  SELECT id, n, 0 AS k, CAST(0 AS BIGINT) AS s, CAST(CASE WHEN n <= {MIN_CHUNK} THEN n ELSE least(n, {MAX_CHUNK}, coalesce((SELECT min(pos) FROM cand WHERE cand.id = f.id AND pos >= {MIN_CHUNK}), n)) END AS BIGINT) AS e FROM f
  UNION ALL
  SELECT id, n, k + 1, e, CAST(CASE WHEN n - e <= {MIN_CHUNK} THEN n ELSE least(n, e + {MAX_CHUNK}, coalesce((SELECT min(pos) FROM cand WHERE cand.id = cuts.id AND pos >= e + {MIN_CHUNK}), n)) END AS BIGINT) FROM cuts WHERE e < n
),
ch AS MATERIALIZED (SELECT id, k, s, cuts.e, sha256(unhex(x[2 * s + 1 : 2 * cuts.e])) AS h FROM cuts JOIN f USING (id))
"""


_DOCS = _chunks("SELECT doc_id AS id, encode(text) AS b FROM documents WHERE text IS NOT NULL")
_PAGES = _chunks("SELECT page_id AS id, encode(html) AS b FROM pages WHERE html IS NOT NULL")
_TURNS = _chunks("SELECT {'c': conv_id, 't': turn, 'r': role} AS id, encode(text) AS b FROM conversations WHERE text IS NOT NULL")

CHUNK_BOUNDS = _DOCS + "SELECT id AS doc_id, k AS chunk_index, s AS start, e AS \"end\", e - s AS size FROM ch"
PAGE_CHUNKS = _PAGES + "SELECT id AS page_id, k AS chunk_index, e - s AS size, h AS chunk_sha256 FROM ch"
DEDUP_BY_SOURCE = _DOCS + """,
m AS (SELECT id, e - s AS size, row_number() OVER (PARTITION BY h ORDER BY id, k) = 1 AS is_new FROM ch)
SELECT source, count(*) AS chunks, count(*) FILTER (is_new) AS unique_chunks, CAST(sum(size) AS BIGINT) AS raw_bytes,
  CAST(coalesce(sum(size) FILTER (is_new), 0) AS BIGINT) AS unique_bytes, CAST(coalesce(sum(size) FILTER (NOT is_new), 0) AS BIGINT) AS dedup_savings
FROM m JOIN documents d ON d.doc_id = m.id GROUP BY source"""
TURN_DEDUP = _TURNS + """
SELECT h AS chunk_sha256, first(id.c ORDER BY id.c, id.t, k) AS conv_id, first(id.t ORDER BY id.c, id.t, k) AS turn, min(e - s) AS size, count(*) AS copies FROM ch GROUP BY h"""
NEW_VS_KNOWN = _TURNS + """
SELECT known, count(*) AS chunks, count(DISTINCT h) AS distinct_chunks, CAST(sum(size) AS BIGINT) AS bytes
FROM (SELECT h, e - s AS size, EXISTS (SELECT 1 FROM ch o WHERE o.h = ch.h AND o.id.r <> 'assistant') AS known FROM ch WHERE id.r = 'assistant') GROUP BY known"""
CONVERT = _DOCS + """,
m AS (SELECT id, k, e - s AS size, row_number() OVER (PARTITION BY h ORDER BY id, k) = 1 AS is_new FROM ch),
p AS (SELECT id, count(*) AS c, count(*) FILTER (is_new) AS u, sum(size) AS n, coalesce(sum(size) FILTER (is_new), 0) AS un FROM m GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS file_size, coalesce(c, 0) AS chunk_count, coalesce(u, 0) AS unique_chunk_count, CAST(coalesce(n - un, 0) AS BIGINT) AS dedup_savings,
  CAST(coalesce(u > 0, false) AS BIGINT) AS xorb_count, CAST(coalesce(un + 8 * u, 0) AS BIGINT) AS xorb_bytes
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN p ON id = doc_id"""
COMPRESSION_RATIO = CONVERT.rsplit("SELECT doc_id", 1)[0] + """SELECT doc_id, CASE WHEN n > 0 THEN round((1 - (un + 8 * u) / CAST(n AS DOUBLE)) * 100, 4) ELSE 0.0 END AS compression_pct
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN p ON id = doc_id"""
STREAM_DEDUP = _TURNS + "SELECT DISTINCT h AS chunk_sha256, e - s AS size FROM ch"

MERKLE_CUT = """
WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, ('0x' || sha256(coalesce(text, ''))[50:50])::INT & 3 = 0 AS f FROM conversations),
w AS (
  SELECT conv_id, turn, i, f, 1 AS n, CAST(0 AS BIGINT) AS g FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.i, t.f, CASE WHEN w.n = 9 OR (w.n >= 3 AND w.f) THEN 1 ELSE w.n + 1 END, w.g + CASE WHEN w.n = 9 OR (w.n >= 3 AND w.f) THEN 1 ELSE 0 END
  FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1
)
SELECT conv_id, turn, g AS group_no FROM w"""

API_HEX = """
SELECT doc_id, list_aggregate([list_aggregate([s[16 * w + 2 * b + 1 : 16 * w + 2 * b + 2] FOR b IN range(7, -1, -1)], 'string_agg', '') FOR w IN range(4)], 'string_agg', '') AS api_hex, s AS sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents)"""


def _packed(overhead: int) -> str:
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
p AS (
  SELECT source, doc_id, size, i, 0 AS x, 0 AS c, CAST(0 AS BIGINT) AS raw, size + {overhead} AS held FROM u WHERE i = 1
  UNION ALL
  SELECT source, u.doc_id, u.size, u.i, CASE WHEN held + u.size + {overhead} > {PACK_CAP} THEN x + 1 ELSE x END, CASE WHEN held + u.size + {overhead} > {PACK_CAP} THEN 0 ELSE c + 1 END,
    CASE WHEN held + u.size + {overhead} > {PACK_CAP} THEN 0 ELSE raw + p.size END, CASE WHEN held + u.size + {overhead} > {PACK_CAP} THEN 0 ELSE held END + u.size + {overhead}
  FROM p JOIN u USING (source) WHERE u.i = p.i + 1
)
"""


XORB_PACK = _packed(8) + "SELECT source, doc_id, size, x AS xorb_index, c AS xorb_chunk, raw AS byte_range_start FROM p"
XORB_PACK_RAW = _packed(0) + "SELECT source, x AS xorb_index, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS raw_bytes FROM p GROUP BY source, x"
XORB_ROUNDTRIP = _packed(8) + "SELECT source, x AS xorb_index, c AS xorb_chunk, p.size, sha256(text) AS chunk_sha256 FROM p JOIN documents USING (source, doc_id)"
XORB_RANGE = _packed(8) + """
SELECT source, x AS xorb_index, CASE WHEN max(c) >= 2 THEN sha256(string_agg(text, '' ORDER BY c) FILTER (c IN (1, 2))) END AS range_sha256, CASE WHEN max(c) < 2 THEN 'RangeOutOfBounds' END AS error
FROM p JOIN documents USING (source, doc_id) GROUP BY source, x"""
CHUNK_READ = _packed(8) + """
SELECT source, x AS xorb_index, CASE WHEN max(c) >= 1 THEN sha256(first(text) FILTER (c = 1)) END AS chunk_sha256, CASE WHEN max(c) < 1 THEN 'ChunkNotFound' END AS error
FROM p JOIN documents USING (source, doc_id) GROUP BY source, x"""
XORB_HEADERS = """
SELECT doc_id, '00' || z || '00' || z AS header
FROM (SELECT doc_id, printf('%02x%02x%02x', n % 256, n // 256 % 256, n // 65536) AS z FROM (SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents))"""
CODEC_ROUNDTRIP = "SELECT doc_id, codec, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents, (VALUES ('none'), ('lz4'), ('bg4'), ('fbs')) c(codec) WHERE text IS NOT NULL"
BYTE_GROUPS = """
SELECT item_id, lower(g) AS grouped, lower(x) AS back
FROM (SELECT item_id, x, list_aggregate([list_aggregate([x[2 * i + 1 : 2 * i + 2] FOR i IN range(p, octet_length(encode(text)), 4)], 'string_agg', '') FOR p IN range(least(4, octet_length(encode(text))))], 'string_agg', '') AS g
  FROM (SELECT item_id, text, hex(encode(text)) AS x FROM benchmark WHERE text IS NOT NULL))
UNION ALL SELECT item_id, NULL, NULL FROM benchmark WHERE text IS NULL"""
BIT_SLICES = """
WITH b AS (SELECT item_id, n, unnest(range(n)) AS j, x FROM (SELECT item_id, octet_length(encode(text)) AS n, hex(encode(text)) AS x FROM benchmark WHERE text IS NOT NULL)),
o AS (
  SELECT item_id, j, sum((((('0x' || x[2 * ((8 * j + k) % n) + 1 : 2 * ((8 * j + k) % n) + 2])::INT >> CAST((8 * j + k) // n AS INT)) & 1)) << CAST(k AS INT)) AS v
  FROM (SELECT *, unnest(range(8)) AS k FROM b) GROUP BY item_id, j
)
SELECT item_id, string_agg(printf('%02x', CAST(v AS INT)), '' ORDER BY j) AS sliced FROM o GROUP BY item_id"""

#: Turns as chunks, each stored once, in the conversation that has it first.
_CONV = """WITH t AS MATERIALIZED (SELECT conv_id, turn, text, strlen(text) AS size, sha256(text) AS h FROM conversations WHERE text <> ''),
fo AS (SELECT h, size, conv_id AS x, turn FROM t QUALIFY row_number() OVER (PARTITION BY h ORDER BY conv_id, turn) = 1),
st AS MATERIALIZED (SELECT h, size, x, row_number() OVER (PARTITION BY x ORDER BY turn) - 1 AS c, CAST(sum(size + 8) OVER (PARTITION BY x ORDER BY turn) AS BIGINT) AS stop FROM fo),
o AS (SELECT conv_id, turn, st.size, x, c, stop, CASE WHEN lag(x) OVER w = x AND lag(c) OVER w + 1 = c THEN 0 ELSE 1 END AS new FROM t JOIN st USING (h) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seg FROM o)
"""
TURN_SEGMENTS = _CONV + "SELECT conv_id, seg AS segment_index, CAST(min(c) AS INT) AS chunk_index_start, CAST(max(c) + 1 AS INT) AS chunk_index_end, CAST(sum(size) AS BIGINT) AS unpacked_segment_size FROM r GROUP BY conv_id, seg"
FETCH_PLAN = _CONV + "SELECT conv_id, seg AS term_index, CAST(min(c) AS INT) AS range_start, CAST(max(c) + 1 AS INT) AS range_end, CAST(sum(size) AS BIGINT) AS unpacked_length, CAST(min(stop - size - 8) AS BIGINT) AS byte_start, max(stop) - 1 AS byte_end FROM r GROUP BY conv_id, seg"
RECONSTRUCTION_JSON = _CONV + "SELECT conv_id, seg AS term_index, CAST(min(c) AS BIGINT) AS range_start, CAST(max(c) + 1 AS BIGINT) AS range_end, CAST(NULL AS VARCHAR) AS error FROM r GROUP BY conv_id, seg"
SHARD_ROUNDTRIP = _CONV + """
SELECT ('0x' || sha256(CAST(conv_id AS VARCHAR))[1:1])::INT AS shard, sha256(CAST(conv_id AS VARCHAR)) AS file_hash, seg AS segment_index, CAST(sum(size) AS BIGINT) AS unpacked_segment_size, CAST(min(c) AS INT) AS chunk_index_start, CAST(max(c) + 1 AS INT) AS chunk_index_end
FROM r GROUP BY conv_id, seg"""
SHARD_INDEX = _CONV + "SELECT CAST(c AS INT) AS chunk_index, CAST(sum(size) OVER (PARTITION BY x ORDER BY c) - size AS BIGINT) AS byte_range_start, size, CAST(max(stop) OVER (PARTITION BY x) AS BIGINT) AS serialized_size FROM st"
SHARD_FOOTERS = _CONV + """,
n AS (SELECT 48 * (count(DISTINCT conv_id) + count(DISTINCT {'c': conv_id, 's': seg})) AS f FROM r),
m AS (SELECT 48 * (count(DISTINCT x) + count(*)) AS s FROM st)
SELECT 0 AS shard, CAST(f + s + 344 AS INT) AS n_bytes, true AS is_keyed, unhex('4d' || repeat('00', 31)) AS chunk_hash_key, TIMESTAMP '2023-11-14 22:13:20' AS created, TIMESTAMP '2023-11-15 22:13:20' AS expires,
  CAST(48 AS BIGINT) AS file_info_offset, CAST(f + 96 AS BIGINT) AS cas_info_offset, CAST(f + s + 144 AS BIGINT) AS footer_offset FROM n, m"""
LOST_XORBS = _CONV + "SELECT conv_id, CASE WHEN bool_or(x IN (SELECT x FROM st GROUP BY x HAVING count(*) > 6)) THEN 'SizeMismatch' END AS error FROM r GROUP BY conv_id"
SPOILED_XORBS = _CONV + """,
bad AS (SELECT x, max(c) AS c FROM st GROUP BY x HAVING count(*) > 6),
e AS (SELECT conv_id, bool_or(bad.x IS NOT NULL) AS spoiled FROM r LEFT JOIN bad USING (x, c) GROUP BY conv_id)
SELECT conv_id, CASE WHEN NOT spoiled THEN h END AS sha256, CASE WHEN spoiled THEN 'HashMismatch' END AS error
FROM e JOIN (SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS h FROM t GROUP BY conv_id) USING (conv_id)"""
XORB_PARTS = _CONV + """,
terms AS (SELECT DISTINCT x, a, b FROM (SELECT first(x) AS x, min(c) AS a, max(c) AS b FROM r GROUP BY conv_id, seg))
SELECT CAST(a AS BIGINT) AS range_start, CAST(c AS BIGINT) AS chunk_index, size, h AS chunk_sha256 FROM terms JOIN st USING (x) WHERE c BETWEEN a AND b"""
STREAM_PIECES = "SELECT conv_id, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", strlen(text) AS size, sha256(text) AS sha256 FROM conversations WHERE text <> ''"
RECONSTRUCT_FULL = "SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS size, sha256(string_agg(text, '' ORDER BY turn)) AS sha256, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE text <> '' GROUP BY conv_id"
RECONSTRUCT_RANGE = """
SELECT conv_id, 2 * n // 3 - n // 3 AS size, sha256(unhex(x[2 * (n // 3) + 1 : 2 * (2 * n // 3)])) AS sha256, CAST(NULL AS VARCHAR) AS error
FROM (SELECT conv_id, hex(encode(string_agg(text, '' ORDER BY turn))) AS x, CAST(sum(strlen(text)) AS BIGINT) AS n FROM conversations WHERE text <> '' GROUP BY conv_id)"""

FETCH_MATCH = """
WITH t AS (SELECT l_orderkey AS f, l_linenumber AS i, l_partkey % 1000 AS x, CAST(l_linenumber AS BIGINT) AS a, CAST(floor(l_linenumber + l_quantity) AS BIGINT) AS b FROM lineitem),
p AS (SELECT p_partkey % 1200 AS x, p_partkey AS pos, p_size % 5 AS s, p_size + 5 AS e, p_name AS url FROM part),
m AS (SELECT t.f, t.i, t.x, t.a, t.b, p.url, p.s, row_number() OVER (PARTITION BY t.f, t.i, t.x, t.a, t.b ORDER BY p.pos) AS k FROM t JOIN p ON p.x = t.x AND p.s <= t.a AND p.e >= t.b)
SELECT error, url, count(*) AS terms, CAST(sum(a - s) AS BIGINT) AS local_start, CAST(sum(b - s) AS BIGINT) AS local_end
FROM (SELECT t.a, t.b, m.url, m.s, CASE WHEN m.s IS NOT NULL THEN NULL WHEN EXISTS (SELECT 1 FROM p WHERE p.x = t.x) THEN 'NoMatchingFetchInfo' ELSE 'MissingFetchInfo' END AS error
  FROM t LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON m.f = t.f AND m.i = t.i AND m.x = t.x AND m.a = t.a AND m.b = t.b)
GROUP BY error, url"""
KEYED_LOOKUP = """
WITH t AS (SELECT conv_id, turn, role, conv_id * 1000 + turn AS pos, text FROM conversations WHERE text <> ''),
f AS (SELECT text, role AS shard, pos AS position FROM t QUALIFY row_number() OVER (PARTITION BY text ORDER BY role, pos) = 1)
SELECT conv_id, turn, shard, position FROM t JOIN f USING (text)"""
VERIFY_STORE = _TURNS + "SELECT id.r AS role, true AS ok, count(*) AS chunks FROM ch GROUP BY id.r"

_ENTRIES = """WITH en AS (SELECT page_id, 'web/' || regexp_extract(url, '^[a-z]+://[^/]*\\.([a-z]+)/', 1) AS namespace, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path, strlen(html) AS size,
  CASE WHEN page_id % 7 <> 0 THEN sha256(html) END AS h, CASE WHEN page_id % 11 = 0 THEN 'directory' ELSE 'file' END AS type FROM pages WHERE url IS NOT NULL)
"""
LIST_FILES = _ENTRIES + "SELECT path, CASE WHEN page_id % 13 <> 0 THEN coalesce(size, 0) ELSE 0 END AS size, h AS file_hash_hex FROM en WHERE type = 'file'"
FIND_FILE = _ENTRIES + """,
na AS (SELECT DISTINCT name FROM (SELECT unnest([path, split_part(path, '/', -1), right(path, 3)]) AS name FROM en) WHERE name <> ''),
fi AS (SELECT name, path, coalesce(size, 0) AS size, h, row_number() OVER (PARTITION BY name ORDER BY page_id, path, size, h) AS k FROM na JOIN en ON type = 'file' AND ends_with(path, name))
SELECT name, path, size, h AS file_hash_hex FROM na LEFT JOIN (SELECT * FROM fi WHERE k = 1) USING (name)"""
NEXT_LINK = "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url END AS target FROM pages WHERE url IS NOT NULL"
REGISTER_FILES = _ENTRIES + "SELECT namespace, path, size, h AS file_hash_hex FROM en QUALIFY row_number() OVER (PARTITION BY namespace, path ORDER BY page_id DESC) = 1"
REGISTRATION_NDJSON = _ENTRIES + "SELECT '{\"type\":\"addFile\",\"path\":\"' || path || '\",\"xetHash\":\"' || h || '\",\"mtime\":0}' AS line FROM en WHERE h IS NOT NULL"
CATALOG_LOOKUP = _ENTRIES + """,
ca AS (SELECT true AS hit, namespace, path, CASE WHEN page_id % 5 <> 0 THEN size END AS size, h FROM en QUALIFY row_number() OVER (PARTITION BY namespace, path ORDER BY page_id DESC) = 1),
re AS (SELECT namespace, path FROM en UNION SELECT 'web/none', path FROM en)
SELECT namespace, path, size, h AS file_hash_hex, CASE WHEN hit IS NULL THEN 'NotFound' WHEN size IS NULL THEN 'InvalidResponse' WHEN h IS NULL THEN 'NotFound' END AS error
FROM re LEFT JOIN ca USING (namespace, path)"""
ENSURE_NAMESPACE = _ENTRIES + "SELECT DISTINCT namespace, namespace NOT LIKE '%com' AS created FROM en"
PUT_IF_ABSENT = """
SELECT doc_id, text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL UNION SELECT text FROM conversations WHERE text IS NOT NULL) AND doc_id = min(doc_id) OVER (PARTITION BY text) AS was_inserted
FROM documents WHERE text IS NOT NULL"""
ERROR_CLASS = """
WITH s AS (SELECT CASE WHEN event_id % 17 <> 0 THEN 200 + event_id % 310 END AS s FROM events),
n AS (SELECT CASE WHEN s IS NULL THEN 'NetworkError' WHEN s BETWEEN 200 AND 299 THEN NULL ELSE coalesce(map {400: 'BadRequest', 401: 'Unauthorized', 403: 'Forbidden', 404: 'NotFound', 416: 'RangeNotSatisfiable', 429: 'TooManyRequests', 500: 'InternalServerError', 503: 'ServiceUnavailable', 504: 'GatewayTimeout'}[s], 'UnexpectedStatus') END AS error, s FROM s)
SELECT error, coalesce(s IS NULL OR s IN (429, 500, 503, 504), false) AS retryable, count(*) AS events FROM n GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    names = [
        "chunk_bounds", "page_chunks", "dedup_by_source", "turn_dedup", "new_vs_known", "convert", "compression_ratio", "stream_dedup",
        "merkle_cut", "api_hex", "xorb_pack", "xorb_pack_raw", "xorb_headers", "xorb_roundtrip", "xorb_range", "chunk_read", "codec_roundtrip", "byte_groups", "bit_slices",
        "turn_segments", "fetch_plan", "reconstruct_full", "reconstruct_range", "stream_pieces", "lost_xorbs", "spoiled_xorbs", "xorb_parts", "reconstruction_json",
        "fetch_match", "keyed_lookup", "shard_roundtrip", "shard_index", "shard_footers", "verify_store",
        "list_files", "find_file", "next_link", "register_files", "registration_ndjson", "catalog_lookup", "ensure_namespace", "put_if_absent", "error_class",
    ]
    return {n: globals()[n.upper()] for n in names}
