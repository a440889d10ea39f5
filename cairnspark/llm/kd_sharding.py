"""K-d tree sharding: weighted-median splits along the widest metadata dimension.

Every split cuts a node's bytes in the proportion of the shards that each side
still has to become, so 24 shards (or any other count) come out near equal.
The medians are found by radix descent: one distributed histogram a digit and
level, of at most ``nodes * BINS`` rows, whatever the size of the input. All
work on rows is DataFrame expressions; the driver only walks histograms.

Ties along a dimension (a hot source, a group of copies) are broken by a hash
of the row's id and text, so a value that holds a third of all rows is cut
through like any other.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, id_bounds, long_array, materialize, shuffle_partitions

#: Children of a histogram step; DIGITS steps resolve BINS ** DIGITS key values.
BIN_BITS, DIGITS = 10, 5
#: Sort key: dimension value, then tie-breaking hash.
DIM_BITS, TIE_BITS = 25, 25
ROW_OVERHEAD = 8
#: Id ranges that a shard is numbered in; bounds what the driver counts.
MAX_PARTS = 4096
DIMENSIONS = ("source", "lang", "size", "id")


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus eight."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_OVERHEAD


def _unit(hashed: Column) -> Column:
    """A hash as a point of [0, 2**DIM_BITS)."""
    return F.shiftrightunsigned(hashed, 64 - DIM_BITS)


def _prepared(docs: DataFrame, id_col: str, text_col: str, categories: tuple[str, ...]) -> DataFrame:
    """(doc_id, size, text_crc32, d0..d3, tie): metadata only, no text."""
    text, key = F.col(text_col), F.col(id_col).cast("bigint")
    cats = [
        _unit(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")))) if c in docs.columns else F.lit(0).cast("bigint")
        for c in categories
    ]
    size = row_size(text)
    return docs.select(
        key.alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        cats[0].alias("d0"),
        cats[1].alias("d1"),
        F.floor(F.log2(size.cast("double")) * (1 << 18)).cast("bigint").alias("d2"),
        F.coalesce(key, F.lit(0).cast("bigint")).alias("d3"),
        F.shiftrightunsigned(F.xxhash64(key, text), 64 - TIE_BITS).alias("tie"),
    )


def _scaled(dim: int, lo: int, hi: int) -> Column:
    """Dimension ``dim`` within [lo, hi] as a DIM_BITS integer, order kept."""
    span = max(1, hi - lo)
    wide = span >> 63  # ids that a difference of two bigints cannot hold
    off = F.col(f"d{dim}").cast("double") - F.lit(float(lo)) if wide else (F.col(f"d{dim}") - F.lit(lo)).cast("double")
    x = off * F.lit(((1 << DIM_BITS) - 1) / span)
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit((1 << DIM_BITS) - 1)).cast("bigint")


def plan_tree(rows: DataFrame, n_shards: int | None, target_bytes: int | None) -> tuple[list[dict], int]:
    """Decide all splits; returns them by level and the number of shards.

    A split: node, dim, lo, hi (scaling), key (rows whose sort key is below it
    go left), left, right (child nodes). A node is (first shard, shards).
    """
    total = rows.agg(F.sum("size").alias("s"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if n_shards is None:
        n_shards = max(1, -(-(total["s"] or 0) // int(target_bytes)))
    root_extent = [max(1, (total[f"hi{i}"] or 0) - (total[f"lo{i}"] or 0)) for i in range(4)]
    open_nodes = {0: n_shards}
    levels: list[list[dict]] = []
    while any(n > 1 for n in open_nodes.values()) and total["s"]:
        placed = rows.withColumn("node", node_of(levels)) if levels else rows.withColumn("node", F.lit(0))
        stats = {
            r["node"]: r
            for r in placed.groupBy("node").agg(F.sum("size").alias("s"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        }
        splits = []
        for node, shards in sorted(open_nodes.items()):
            if shards < 2 or node not in stats:
                continue
            st = stats[node]
            extent = [(st[f"hi{i}"] - st[f"lo{i}"]) / root_extent[i] for i in range(4)]
            dim = max(range(4), key=lambda i: (extent[i], -i))
            left = shards // 2
            splits.append({"node": node, "dim": dim, "lo": st[f"lo{dim}"], "hi": st[f"hi{dim}"], "left": node, "right": node + left, "n_left": left, "n_right": shards - left, "want": st["s"] * left / shards, "key": 0})
        if not splits:
            break
        _find_medians(placed, splits)
        levels.append(splits)
        for s in splits:
            open_nodes[s["left"]] = s["n_left"]
            open_nodes[s["right"]] = s["n_right"]
    return levels, n_shards


def _find_medians(placed: DataFrame, splits: list[dict]) -> None:
    """Radix descent to each split's weighted median, one digit a pass."""
    width = DIM_BITS + TIE_BITS
    key = sort_key(splits)
    keyed = placed.filter(F.col("node").isin([s["node"] for s in splits])).select("node", "size", key.alias("key"))
    by_node = {s["node"]: s | {"before": 0, "prefix": 0} for s in splits}
    for digit in range(DIGITS):
        shift = width - BIN_BITS * (digit + 1)
        inside = keyed
        if digit:
            known = F.create_map(*[F.lit(x) for n, s in by_node.items() for x in (n, s["prefix"])])
            inside = keyed.filter(F.shiftright("key", shift + BIN_BITS) == known[F.col("node")])
        counts = defaultdict(list)
        for r in inside.groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect():
            counts[r["node"]].append((r["bin"], r["s"], r["n"]))
        single = True
        for node, bins in counts.items():
            s, chosen = by_node[node], None
            for b, size, n in sorted(bins):
                chosen = (b, size, n)
                if s["before"] + size > s["want"]:
                    break
                s["before"] += size
            else:
                s["before"] -= chosen[1]
            s["prefix"], s["last"] = chosen[0], (chosen[1], chosen[0])
            single = single and chosen[2] == 1
        if single or digit == DIGITS - 1:
            for s in splits:
                st = by_node[s["node"]]
                size, b = st["last"]
                # the median's own row goes to the side that comes nearer to its share
                s["key"] = (b + (st["before"] + size / 2 <= s["want"])) << shift
            return


def sort_key(splits: list[dict]) -> Column:
    out = F.lit(None).cast("bigint")
    for s in splits:
        out = F.when(F.col("node") == s["node"], F.shiftleft(_scaled(s["dim"], s["lo"], s["hi"]), TIE_BITS).bitwiseOR(F.col("tie"))).otherwise(out)
    return out


def node_of(levels: list[list[dict]]) -> Column:
    """The node of a row after all splits decided so far.

    One expression: the tree's path as nested CASEs, so a row is compared with
    one split a level.
    """
    def descend(level: int, node: int) -> Column:
        for at in range(level, len(levels)):
            for s in levels[at]:
                if s["node"] == node:
                    key = F.shiftleft(_scaled(s["dim"], s["lo"], s["hi"]), TIE_BITS).bitwiseOR(F.col("tie"))
                    return F.when(key < F.lit(s["key"]), descend(at + 1, s["left"])).otherwise(descend(at + 1, s["right"]))
        return F.lit(node)

    return descend(0, 0)


def kd_shards(
    docs: DataFrame,
    n_shards: int | None = 24,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, str] = ("source", "lang"),
) -> DataFrame:
    """Shard ``docs`` by a k-d tree over (source, lang, log size, id).

    ``n_shards`` fixes the number of leaves; else it follows from
    ``target_bytes``. Returns one row per input row: doc_id, size, text_crc32,
    law ('bytes'), shard, slot (0.. within the shard, by id then text hash),
    grown_shard (null: law 'key' alone has it).

    Edge cases: a null text counts as no bytes (size 8) and has the CRC of the
    empty string; null ids sort first; null or missing metadata columns count
    as one category; ids may be any bigint; repeated rows each get their own slot, in any order among
    themselves, though rows equal in id and text go to one side of every split,
    as no key tells them apart. An empty table gives no rows. More shards than rows leave shards
    empty. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = materialize(_prepared(docs, id_col, text_col, categories), "kd-meta")
    levels, n = plan_tree(rows, n_shards, target_bytes)
    placed = rows.select("doc_id", "size", "text_crc32", "tie", node_of(levels).cast("int").alias("shard"))
    # Slots in two steps: id ranges within a shard are numbered alone, then
    # shifted by what the ranges before them hold; no task sees a whole shard.
    bounds = id_bounds(rows, "doc_id", min(MAX_PARTS, shuffle_partitions(spark)))
    placed = materialize(placed.withColumn("part", bucket_of(F.col("doc_id"), bounds)), "kd-placed")
    counts = sorted((r["shard"], r["part"], r["n"]) for r in placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    width, seen, base = len(bounds) + 1, defaultdict(int), {}
    for shard, part, k in counts:
        base[shard * width + part] = seen[shard]
        seen[shard] += k
    dense = [base.get(i, 0) for i in range(n * width)]
    w = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "tie", "text_crc32")
    first = F.get(long_array(dense), F.col("shard") * width + F.col("part"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (first + F.row_number().over(w) - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

