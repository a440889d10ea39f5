"""Line dedup by a segment-partition edit join.

Lines within THRESHOLD edits of each other form classes (transitively); of each
class the first line in (doc_id, line number) order stays, the others go.

Candidates: a line of length l is cut into THRESHOLD + 1 near-equal segments,
filed by (l, segment number, content). A line of length l or up to THRESHOLD
more within the threshold holds one of these segments unchanged, at one of few
start positions (multi-match-aware selection); its substrings there probe the
same index. Lines that share a key are verified with a banded bit-parallel edit
distance, many pairs at a time.

Keys of more than CROWD lines are not enumerated. At threshold one their lines
are linked by one-deletion keys instead: equal rests after deleting position i
from both (a substitution), or a line equal to another less one character (an
insertion); a star around the smallest id of each such key has the same
components as all pairs, with two rows a character.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fit, materialize, slices, unused, whole_texts
from .components import components

THRESHOLD = 1
#: Shorter lines are compared for equality alone: an edit changes too much of
#: them. Lines of blanks alone are not compared; they part what stands around.
MIN_CHARS = 20
_NOT_BLANK = "[^ \\t-\\r]"
CROWD = 32
#: The seed that Spark's xxhash64 has; Python makes the same line ids with it.
LINE_SEED = 42
_BLANKS = " \t\n\x0b\f\r"


# -- verification -----------------------------------------------------------


def within(pairs: list[tuple[str, str]], limit: int) -> np.ndarray:
    """For each pair of strings, whether their edit distance is <= ``limit``.

    Lanes of pairs go through one banded bit-parallel recurrence: the vertical
    differences of the 2 * limit + 1 cells around the diagonal are bits of one
    word that slides down by one each column (limit <= 30).
    """
    out = np.zeros(len(pairs), bool)
    a_codes, b_codes, at = [], [], []
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > limit:
            continue
        if a == b:
            out[i] = True
            continue
        x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = min(len(x), len(y))
        # edits lie between the common ends
        diff = np.flatnonzero(x[:n] != y[:n])
        lead = int(diff[0]) if len(diff) else n
        x, y = x[lead:], y[lead:]
        n = min(len(x), len(y))
        diff = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
        tail = int(diff[0]) if len(diff) else n
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if min(len(x), len(y)) == 0:
            out[i] = max(len(x), len(y)) <= limit
        else:
            a_codes.append(x)
            b_codes.append(y)
            at.append(i)
    order = sorted(range(len(at)), key=lambda k: len(b_codes[k]))
    for s in range(0, len(order), 1024):
        lanes = order[s : s + 1024]
        ok = _banded([a_codes[k] for k in lanes], [b_codes[k] for k in lanes], limit)
        out[[at[k] for k in lanes]] = ok
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """Edit distance <= k for lanes of code arrays (rows a, columns b), whose
    lengths differ by k at most."""
    width = 2 * k + 4
    lead = width - 1 - k  # band rows above the diagonal
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    longest = int(n_b.max())
    # at column j, bit r of the band is index j - lead + r of a
    pad_a = np.zeros((len(a), longest + width), np.uint32)
    live_a = np.zeros(pad_a.shape, bool)
    pad_b = np.zeros((len(b), longest), np.uint32)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        m = min(len(x), pad_a.shape[1] - lead)
        pad_a[i, lead : lead + m], live_a[i, lead : lead + m] = x[:m], True
        pad_b[i, : len(y)] = y
    one, mask, last = np.uint64(1), np.uint64((1 << width) - 1), np.uint64(width - 1)
    # bits of vp / vn: a cell is one more / less than the cell above it
    vp = np.full(len(a), ((1 << width) - 1) & ~((1 << lead) - 1), np.uint64)
    vn = np.zeros(len(a), np.uint64)
    score = np.minimum(k, n_a).astype(np.int64)
    final = np.full(len(a), 1 << 30, np.int64)
    for j in range(longest):
        eq = np.zeros(len(a), np.uint64)
        for r in range(width):
            eq |= ((pad_a[:, j + r] == pad_b[:, j]) & live_a[:, j + r]).astype(np.uint64) << np.uint64(r)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        # down the band's lowest diagonal, then along the table's last row
        diagonal = j < n_a - k
        row = np.clip(n_a - j - 1 + lead, 0, width - 1).astype(np.uint64)
        down = one - ((d0 >> last) & one)
        along = ((hp >> row) & one).astype(np.int64) - ((hn >> row) & one).astype(np.int64)
        score += np.where(diagonal, down.astype(np.int64), along)
        x = d0 >> one
        vp, vn = (hn | ~(x | hp)) & mask, x & hp
        final = np.where(n_b == j + 1, score, final)
    return final <= k


# -- candidates --------------------------------------------------------------


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, line_no, line): one row a line of every text."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), doc_key(id_col, text_col).alias("doc_key"), F.col(text_col).alias("text"))
    return base.select("doc_id", "doc_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def doc_key(id_col: str, text_col: str) -> Column:
    """Tells apart rows that share an id; rows equal in both are one document."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))


def _line_id(line: Column) -> Column:
    return F.xxhash64(line)


@lru_cache(1 << 16)
def _spans(n: int, k: int) -> list[tuple[int, int, int]]:
    """(seed, start, end) of the index keys and probes of a line of ``n``
    characters; the keys are among the probes at equal length. The seed tells
    the indexed length and the segment's number."""
    out = []
    for delta in range(k + 1):
        m = n - delta  # length of the indexed lines
        if m <= k:
            continue
        short, n_short = m // (k + 1), (k + 1) - m % (k + 1)
        for i in range(1, k + 2):
            start, size = short * (i - 1) + max(0, i - 1 - n_short), short + (i > n_short)
            lo, hi = max(-(i - 1), delta - (k + 1 - i)), min(i - 1, delta + (k + 1 - i))
            out += [((m << 6) + i, at, at + size) for at in range(max(0, start + lo), min(start + hi, n - size) + 1)]
    return out


def _cells(docs: DataFrame, text_col: str, min_chars: int, k: int) -> DataFrame:
    """(h, key): the keys of every line of at least ``min_chars``, with the
    line's id."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            h, key = [], []
            for text in batch.column(0).to_pylist():
                for line in text.split("\n") if text else ():
                    n = len(line)
                    if n < min_chars or not line.strip(_BLANKS):
                        continue
                    spans = _spans(n, k)
                    h.append((xxh64_intdigest(line, LINE_SEED), len(spans)))
                    key += [xxh64_intdigest(line[a:b], seed) for seed, a, b in spans]
            ids = np.repeat(np.array([x for x, _ in h], np.uint64), [c for _, c in h]) if h else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(np.array(key, np.uint64).view(np.int64))], ["h", "key"])

    return whole_texts(docs.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "h bigint, key bigint")


def _hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = lines_of(docs, id_col, text_col).filter((F.char_length("line") >= min_chars) & F.col("line").rlike(_NOT_BLANK))
    return lines.withColumn("h", _line_id(F.col("line"))).withColumn("h2", F.xxhash64(F.lit(7), F.col("line")))


def _deletion_keys(crowd: DataFrame) -> DataFrame:
    """(key, h, center) of crowd lines (h, line): see the module's text."""

    def run(batches):
        r = np.uint64(0x9E3779B97F4A7C15 | 1)
        r_inv = np.uint64(pow(int(r), -1, 1 << 64))
        for batch in batches:
            for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
                n = len(codes)
                powers = np.cumprod(np.full(n, r, np.uint64), dtype=np.uint64)
                pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
                rest = pre[:-1] + (pre[-1] - pre[1:]) * r_inv
                mix = np.uint64(0xC2B2AE3D27D4EB4F)
                tagged = lambda x, tag: (x ^ (np.asarray(tag, np.uint64) * mix)) * r
                shorter, same = tagged(rest, 0), tagged(rest, np.arange(1, n + 1, dtype=np.uint64))
                keys = np.concatenate([tagged(pre[-1:], 0), shorter, same])
                center = np.zeros(len(keys), np.int8)
                center[0], center[1 : n + 1] = 1, 2
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), h, np.int64)), pa.array(center)], ["key", "h", "center"])

    return crowd.mapInArrow(run, "key bigint, h bigint, center tinyint").distinct()


def line_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) of line ids (XXH64 of the line): verified pairs within the
    threshold, with the same components as all such pairs."""
    lines = _hashed_lines(docs, id_col, text_col, min_chars)
    cells = materialize(_cells(docs, text_col, min_chars, threshold), "lines-cells")
    keys = cells.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).filter("a < z").select("key")
    keys = materialize(keys, "lines-keys")
    shared = materialize(cells.join(fit(keys), "key").select("key", "h").distinct(), "lines-shared")
    sizes = materialize(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "lines-sizes")
    sized = shared.join(sizes, "key")
    few = sized if threshold > 1 else sized.filter(F.col("n") <= crowd)
    members = few.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("m"))
    pairs = members.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    pairs = pairs.distinct()
    if threshold == 1:
        ids = materialize(sized.filter(F.col("n") > crowd).select("h").distinct(), "lines-crowd")
        text = lines.join(fit(ids), "h").select("h", "line").dropDuplicates(["h"])
        dels = materialize(_deletion_keys(text), "lines-deletions")
        star = dels.filter("center <> 0").groupBy("key").agg(F.min(F.when(F.col("center") == 1, F.col("h"))).alias("c"))
        star = star.filter("c is not null")
        inserted = dels.filter("center = 2").join(materialize(star, "lines-centers"), "key").filter("h <> c").select(F.least("h", "c").alias("a"), F.greatest("h", "c").alias("b"))
        subs = dels.filter("center = 0").groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).filter("a < z").select("key", "a")
        changed = dels.filter("center = 0").join(materialize(subs, "lines-subs"), "key").filter("h > a").select("a", F.col("h").alias("b"))
        pairs = pairs.union(inserted).union(changed).distinct()
    pairs = materialize(pairs, "lines-pairs")
    ids = materialize(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("h")), "lines-ids")
    text = materialize(lines.join(fit(ids), "h").select("h", "h2", "line").dropDuplicates(["h", "h2"]).select("h", "line"), "lines-texts")
    both = pairs.join(text.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(text.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")

    def verify(batches):
        for part in slices(batches, 2048):
            ok = within(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)), threshold)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """(doc_key, doc_id, drop): the line numbers to drop, of documents that
    have any. One group is one document's lines."""
    edges = materialize(line_links(docs, id_col, text_col, threshold, min_chars, crowd), "lines-edges")
    linked = materialize(components(edges), "lines-classes").select(F.col("node").alias("h"), "component")
    order = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit("-9223372036854775809").cast("decimal(19,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")
    lines = _hashed_lines(docs, id_col, text_col, 1).select("doc_id", "doc_key", "line_no", "h", "h2", order.cast("decimal(38,0)").alias("o"))
    lines = lines.join(fit(linked), "h", "left")
    # a linked line's class is its component; any other's is its own two hashes
    lines = lines.select("doc_id", "doc_key", "line_no", "o", F.coalesce("component", "h").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0).cast("bigint")).alias("c2"))
    first = lines.groupBy("c1", "c2").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter("first < last").select("c1", "c2", "first")
    first = materialize(first, "lines-first")
    gone = lines.join(fit(first), ["c1", "c2"]).filter("o > first")
    return gone.groupBy("doc_key", "doc_id").agg(F.collect_set("line_no").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with repeated lines removed from the texts: exact repeats of any
    line that is not blank, and of at least ``min_chars`` characters those within
    ``threshold`` edits too; all rows and columns stay, ``n_chars`` (where
    present) follows the text.

    ``counts`` names two integer columns to add: lines of the text, and lines
    dropped.

    Edge cases: a null text stays null; a text that loses all lines becomes
    empty; line ends stay between the lines that are kept; rows that repeat an
    (id, text) count as one document and get one result; a null id comes first;
    an empty table gives no rows; extra columns may have any name. Thresholds over one enumerate every pair of
    lines that share a key (no crowd rule is exact there).
    """
    drops = materialize(dropped_lines(docs, id_col, text_col, threshold, min_chars, crowd), "lines-drops")
    key, own, no, drop_col = unused(docs, "key_of_drops", "key_of_row", "id_of_drops", "drops")
    side = drops.select(F.col("doc_key").alias(key), F.col("doc_id").alias(no), F.col("drop").alias(drop_col))
    keyed = docs.withColumn(own, doc_key(id_col, text_col))
    on = (F.col(own) == F.col(key)) & F.col(id_col).cast("bigint").eqNullSafe(F.col(no))
    joined = keyed.join(side, on, "left").drop(own, key, no)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts or ()]])
    at_text = docs.columns.index(text_col)
    at_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    n_cols = len(docs.columns)

    def rewrite(batches):
        for batch in slices(batches):
            texts, drop = batch.column(at_text).to_pylist(), batch.column(n_cols).to_pylist()
            n_lines = [0 if t is None else t.count("\n") + 1 for t in texts]
            cols = [batch.column(i) for i in range(n_cols)]
            changed = [i for i, d in enumerate(drop) if d]
            if changed:
                for i in changed:
                    gone = set(drop[i])
                    texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in gone)
                cols[at_text] = pa.array(texts, cols[at_text].type)
                if at_chars is not None:
                    chars = cols[at_chars].to_pylist()
                    for i in changed:
                        chars[i] = len(texts[i])
                    cols[at_chars] = pa.array(chars, cols[at_chars].type)
            if counts:
                cols += [pa.array(n_lines, pa.int64()), pa.array([len(d or ()) for d in drop], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return whole_texts(joined).mapInArrow(rewrite, schema)
