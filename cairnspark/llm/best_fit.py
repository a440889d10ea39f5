"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once. Documents longer than the
largest are cut into pieces of that length and a rest. Pieces go by descending
length into the open bin with the least room that still holds them; a piece
that fits nowhere opens a bin of the size that costs least a token. A sequence
of c tokens costs BIN_COST + c * (1 + c / ATTENTION): a fixed part, one that is
linear and one that is quadratic in its length. What a size would hold is taken
from the lengths still to come: the piece and, greedily, the longest of them
that fit into what room is left. Finally each bin is downsized to the smallest
permitted length that holds its contents.

Rows are dealt to groups of about GROUP_ROWS by a hash of id, length and text;
each group is packed alone, from (id, length) rows, so no task's work grows
with the input and the only loss is a few partly filled bins a group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_texts

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Fixed cost of a sequence, in tokens, and the length at which the quadratic
#: part of its cost equals the linear one.
BIN_COST, ATTENTION = 16, 65_536
GROUP_ROWS = 20_000


def sequence_cost(capacity: int, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> float:
    return bin_cost + capacity * (1 + capacity / attention)


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset of each item in it, final capacity of each
    bin). Lengths are from 0 to the largest capacity; ties go by position, and
    to the smaller of two sizes."""
    capacities = sorted(set(capacities))
    price = {c: cost(c) for c in capacities}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    # what is still to come: all of the shorter lengths, and `same` of this one
    sizes = sorted(set(lengths))
    counts = [0] * len(sizes)
    for n in lengths:
        counts[bisect_left(sizes, n)] += 1

    def held(n: int, room: int, same: int) -> int:
        """Tokens that a bin with an item of ``n`` and ``room`` beside it holds."""
        full, at = n + room, bisect_left(sizes, n)
        below = at + 1
        while room > 0:
            k = bisect_right(sizes, room, 0, below) - 1
            if k < 0 or sizes[k] == 0:
                break
            room -= sizes[k] * min(same if k == at else counts[k], room // sizes[k])
            below = k
        return full - room

    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    filled: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    last, same = None, 0
    for i in order:
        n = lengths[i]
        last, same = n, (same if n == last else counts[bisect_left(sizes, n)]) - 1
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = min((price[c] / max(1, held(n, c - n, same)), c) for c in capacities if c >= n)[1], len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        if left - n > 0:
            insort(room, (left - n, b))
    return bins, offsets, [capacities[bisect_left(capacities, f)] for f in filled]


def word_tokens(text: Column) -> Column:
    """Length of a document: its blank-separated words and an end token."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")) + 1).cast("bigint")


def token_lengths(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n, h) of rows (doc_id, text, h): n is the text's tokens by a
    tokenizer file, without special ones, and an end token."""
    from .simple8b import regrouped, words_for

    def run(batches):
        table = words_for(tokenizer)
        for b in regrouped(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(table.counts(b.column(1)) + 1, pa.int64()), b.column(2)], ["doc_id", "n", "h"])

    return whole_texts(rows.select("doc_id", "text", "h")).mapInArrow(run, "doc_id bigint, n bigint, h bigint")


SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, bin string, offset bigint, capacity bigint"


def best_fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    length: Column | None = None,
    text_col: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    bin_cost: float = BIN_COST,
    group_rows: int = GROUP_ROWS,
    attention: float = ATTENTION,
    tokenizer: str | None = None,
) -> DataFrame:
    """Per piece: doc_id, piece (0..), start and length within the document,
    bin, offset within it, and the bin's capacity after downsizing.

    A document's tokens are its ``length`` if given, else what the tokenizer
    file ``tokenizer`` makes of it and an end token, else its words and an end
    token. Nothing is dropped or cut short: pieces of a document add up to its
    length. Edge cases: null and empty texts are one end token; a null or
    negative length counts as none and still gives one piece; null ids and
    repeated rows are packed as rows of their own, dealt to all groups however
    many they are; the result depends on the rows alone, not on their order or
    place; an empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    text = F.col(text_col).cast("string")
    picked = [F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h")]
    if length is None and tokenizer:
        rows = token_lengths(docs.select(*picked, text.alias("text")), tokenizer)
    else:
        n = F.coalesce((length if length is not None else word_tokens(text)).cast("bigint"), F.lit(0))
        rows = docs.select(*picked, F.greatest(n, F.lit(0)).alias("n"))
    # equal rows are one row and a number until they are dealt out
    rows = materialize(rows.groupBy("doc_id", "n", "h").agg(F.count(F.lit(1)).alias("c")), "fit-lengths")
    n_groups = max(1, -(-(rows.agg(F.sum("c").alias("c")).first()["c"] or 0) // group_rows))
    span = F.lit(group_rows).cast("bigint")
    lone = rows.filter(F.col("c") <= span).withColumn("at", F.lit(0).cast("bigint"))
    many = rows.filter(F.col("c") > span).withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1, span)))
    many = many.withColumn("c", F.least(span, F.col("c") - F.col("at"))).repartition("doc_id", "n", "h", "at")
    each = lone.union(many).select("doc_id", "n", "h", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("c") - 1)).alias("copy"))
    rows = each.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n", "h", "copy"), F.lit(n_groups)).cast("int").alias("group"))
    largest, caps = max(capacities), tuple(capacities)

    def run(table: pa.Table) -> pa.Table:
        got = sorted(zip(table.column("doc_id").to_pylist(), table.column("n").to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        group = table.column("group")[0].as_py()
        out: list[tuple] = []
        for doc, n in got:
            for p, start in enumerate(range(0, max(n, 1), largest)):
                out.append((doc, p, start, min(largest, n - start)))
        bins, offsets, sizes = pack([r[3] for r in out], caps, lambda c: sequence_cost(c, bin_cost, attention))
        cols = list(zip(*out, strict=True))
        return pa.table(
            {
                "doc_id": pa.array(cols[0], pa.int64()),
                "piece": pa.array(cols[1], pa.int32()),
                "start": pa.array(cols[2], pa.int64()),
                "length": pa.array(cols[3], pa.int64()),
                "bin": [f"{group}-{b}" for b in bins],
                "offset": pa.array(offsets, pa.int64()),
                "capacity": pa.array([sizes[b] for b in bins], pa.int64()),
            }
        )

    return rows.groupBy("group").applyInArrow(run, SCHEMA)
