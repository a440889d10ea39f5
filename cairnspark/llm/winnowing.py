"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Both sides hash their k-grams of words (k = K) and keep the minimum of every
run of W consecutive hashes, the leftmost on ties. A shared span of at least
K + W - 1 = WINDOW words holds a full run, whose minimum both sides keep, so
every occurrence of a WINDOW-word passage shares a fingerprint at the same
offset. Each shared fingerprint is then extended: the words around it are
compared with the item's, and the windows that agree word for word are hits.

Items shorter than WINDOW words are one window each; they are looked up whole,
by the hash of all runs of their length.

A document's k-grams are hashed and tested against a byte map of the benchmark's
fingerprints in generated code, one word after the other. The few that may be
known are then winnowed by the words around them, which hold every run that
they are in; so rows are kept for (probable) hits alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit, fold_case, materialize

WINDOW = 10
K = 5
W = WINDOW - K + 1
#: Words: runs of anything but ASCII that is neither a digit nor a letter.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: The byte map has 16 slots a fingerprint, within these bounds; beyond the
#: upper one it only filters less. A fingerprint has PROBES slots, cut from
#: different bits of it; but one where the map is less wide.
MIN_SLOTS, MAX_SLOTS = 1 << 12, 1 << 22
PROBES = 3


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(fold_case(text), F.lit("")), NOT_WORD), "")


def _gram(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def _grams(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words; position i starts at word i."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _gram(words, i, n))).otherwise(
        F.array().cast("array<bigint>")
    )


def _selected(hashes: Column) -> Column:
    """Positions kept by winnowing, ascending, each once; none where there are
    fewer than W hashes.

    Per run: the position of its minimum, the first one on ties; runs of equal
    choice follow each other, so comparing neighbours removes repeats.
    """
    last = F.size(hashes) - W

    def choice(i: Column) -> Column:
        run = F.slice(hashes, i + 1, W)
        return i - 1 + F.array_position(run, F.array_min(run)).cast("int")

    chosen = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), choice)
    return F.when(last >= 0, F.array_distinct(chosen)).otherwise(F.array().cast("array<int>"))


def _context(words: Column, at: Column) -> Column:
    """The words from W - 1 before ``at`` to W - 1 past the k-gram, null outside."""
    return F.transform(F.sequence(at - (W - 1), at + (K + W - 2)), lambda i: F.when(i >= 0, F.get(words, i)))


def _item_tables(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Long items' fingerprints (h, item_id, ctx), short items' windows
    (h, item_id, words), and the lengths of the latter."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w"))
    items = materialize(items.filter((F.size("w") > 0) & F.col("item_id").isNotNull()), "winnow-items")
    w = F.col("w")
    long = items.filter(F.size("w") >= WINDOW).select("item_id", "w", _grams(w, K).alias("g"))
    long = long.select("item_id", "w", "g", F.explode(_selected(F.col("g"))).alias("q"))
    long = long.select(F.get("g", F.col("q")).alias("h"), "item_id", _context(F.col("w"), F.col("q")).alias("ictx")).distinct()
    short = items.filter(F.size("w") < WINDOW)
    lengths = sorted(r[0] for r in short.select(F.size("w")).distinct().collect())
    short_hash = F.lit(None).cast("bigint")
    for n in lengths:
        short_hash = F.when(F.size("w") == n, _gram(F.col("w"), F.lit(0), n)).otherwise(short_hash)
    short = short.select(short_hash.alias("h"), "item_id", F.col("w").alias("ictx")).distinct()
    return materialize(long, "winnow-long"), materialize(short, "winnow-short"), lengths


def _slot_map(tables: list[DataFrame]) -> tuple[bytes, int, int]:
    """One byte a slot, 1 where some fingerprint of the benchmark falls; the
    slots, and the probes a fingerprint."""
    hashes = tables[0].select("h")
    for t in tables[1:]:
        hashes = hashes.union(t.select("h"))
    n = hashes.count()
    slots = MIN_SLOTS
    while slots < min(16 * n, MAX_SLOTS):
        slots *= 2
    probes = PROBES if slots >= 16 * n else 1
    used = hashes.select(F.explode(F.array(*[_slot(F.col("h"), slots, i) for i in range(probes)])).alias("s")).distinct()
    table = bytearray(slots)
    for r in used.toLocalIterator():
        table[r["s"]] = 1
    return bytes(table), slots, probes


def _slot(h: Column, slots: int, probe: int) -> Column:
    return F.pmod(F.shiftright(h, 20 * probe) if probe else h, F.lit(slots)).cast("int")


def hits(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", doc_text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): per input row ``row`` (its number), n_words and the
    columns ``keep``; and per verified hit (row, item_id, first, last) in words.
    """
    long, short, lengths = _item_tables(benchmark, item_col, text_col)
    found = materialize(_found(docs, doc_text_col, keep or [], lengths, *_slot_map([long, short])), "winnow-docs")
    rows = found.filter("p < 0").select(*(keep or []), "row", "n_words")
    cand = found.filter("p >= 0").select("row", "p", "n", "h", "ctx")

    on_long = cand.filter("n = 0").join(fit(long), "h")
    same = F.zip_with("ctx", "ictx", lambda a, b: F.coalesce(a == b, F.lit(False)))
    starts = F.filter(F.sequence(F.lit(0), F.lit(W - 1)), lambda s: F.forall(F.slice(F.col("same"), s + 1, WINDOW), lambda x: x))
    on_long = on_long.select("row", "item_id", "p", same.alias("same")).withColumn("s", starts).filter(F.size("s") > 0)
    at = F.col("p") - (W - 1)
    spans = on_long.select("row", "item_id", (at + F.array_min("s")).alias("first"), (at + F.array_max("s") + (WINDOW - 1)).alias("last"))
    if lengths:
        on_short = cand.filter("n > 0").join(fit(short), "h").filter(F.col("ctx") == F.col("ictx"))
        spans = spans.union(on_short.select("row", "item_id", F.col("p").alias("first"), (F.col("p") + F.col("n") - 1).alias("last")))
    return rows, spans


def _found(docs: DataFrame, text_col: str, keep: list[str], lengths: list[int], table: bytes, slots: int, probes: int) -> DataFrame:
    """Per input row one row of p = -1 with n_words and ``keep``, and one for each
    probable hit: p, n (0: a fingerprint; else words of a short item), h, ctx.

    Lambdas are interpreted and would take microseconds a word, so none is
    applied before the map has been asked. Explodes also keep Spark from
    computing what they make once more in the conditions that follow them.
    """
    flags = F.lit(table)
    w, p, h, near = (F.col(c) for c in ("w", "p", "h", "near"))
    known = F.lit(True)
    for i in range(probes):
        known &= F.substring(flags, _slot(h, slots, i) + 1, F.lit(1)) == F.lit(b"\x01")

    def run(n: int) -> Column:
        return F.when((p >= 0) & F.get(w, p + (n - 1)).isNotNull(), _gram(w, p, n))

    rows = docs.select(*keep, F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("w"))
    rows = rows.select(*keep, "row", "w", F.size(w).alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size(w) - 1)).alias("p"))
    rows = rows.select(*keep, "row", "w", "n_words", "p", F.posexplode(F.array(*[run(n) for n in [K, *lengths]])).alias("kind", "h"))
    rows = rows.filter(((p < 0) & (F.col("kind") == 0)) | known)
    # the words of all runs of W hashes that p is in, and its place in them
    around = F.slice(w, F.greatest(p - (W - 1), F.lit(0)) + 1, F.when(p < 0, 0).otherwise(F.least(p, F.lit(W - 1)) + K + W - 1))
    at = F.least(p, F.lit(W - 1))
    rows = rows.select(*keep, "row", "n_words", "p", "kind", "h", F.explode(F.array(around)).alias("near"))
    kept = F.exists(F.array(_grams(near, K)), lambda g: F.array_contains(_selected(g), at))
    rows = rows.filter((p < 0) | (F.col("kind") > 0) | kept)
    n = F.get(F.array(*[F.lit(n) for n in [0, *lengths]]), F.col("kind"))
    ctx = F.when(p >= 0, F.when(n == 0, _context(near, at)).otherwise(F.slice(near, at + 1, n)))
    return rows.select(*[F.when(p < 0, F.col(c)).alias(c) for c in keep], "row", "n_words", "p", n.alias("n"), "h", ctx.alias("ctx"))


def _covered(spans: Column) -> Column:
    """Words covered by sorted [first, last] spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["last"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit when it lies inside an occurrence of some window:
    WINDOW consecutive words of an item, or all words of a shorter item.

    Edge cases: a null or empty text has no words and no hits; items that are
    null, have no word or no id are ignored; repeated items or rows each count
    as they are (an item id once); an empty benchmark leaves every document
    clean; an empty ``docs`` gives no rows. Ids may be null or repeat: rows are
    told apart by number. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep or [])])
    kept = ["doc_id", *[f"k{i}" for i in range(len(keep or []))]]
    rows, spans = hits(base, benchmark, item_col, item_text_col, keep=kept)
    # One group is one document: its distinct spans are at most a few per word.
    words = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    words = words.select("row", _covered(F.col("spans")).cast("bigint").alias("n_hit"))
    items = spans.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    items = items.select("row", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    per_row = words.join(items, "row")
    out = rows.join(per_row, "row", "left")
    return out.select(
        F.col("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_SHA256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep or [])],
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark window.

    Rows equal in id and text share their verdict. Null ids and texts are
    judged like any other (a null text is clean).
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    base = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    bad = decontaminate(base, benchmark, "key", "text", item_col, item_text_col).filter("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    bad = fit(materialize(bad, "winnow-bad"))
    return docs.join(bad, key == bad["__bad"], "left_anti")
