"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments, a
point of a 32-dimensional lattice. The Manhattan distance of two points is a
lower bound of the fingerprints' Hamming distance: one differing bit moves one
coordinate by one. Fingerprints within RADIUS bits are therefore lattice points
within Manhattan distance RADIUS, which differ in RADIUS coordinates at most.

Grid range-join: the coordinates are dealt to AXES axes; two points in range
agree on all but RADIUS axes, so each point is filed under the cells of all
choices of ``AXES - RADIUS`` axes, and points sharing a cell are compared, by
Manhattan distance first and exactly after. No pair in range is missed.

A crowded cell is not enumerated. Its fingerprints are linked through their
one-bit neighbours instead: two fingerprints are within two bits exactly if
their radius-one balls meet, and a ball has 65 points, so a star around the
smallest fingerprint of every shared point gives the same components with a
number of edges linear in the crowd.

Two bits are the contract of :func:`near_duplicates`. A text that shares 0.8 of
its five-word shingles with another is some ten bits away from it, too far for
any grid of 64 bits; :func:`drop_near_duplicates` therefore finds such pairs
besides, from minima of the shingles' hashes (see :func:`similar_pairs`), and
verifies each by the shingles themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fit, materialize, slices, whole_texts
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
SEGMENT_BITS, AXES = 2, 6
#: Cells of more distinct fingerprints than this are linked by one-bit balls.
CROWD = 32
#: Shingles hashed at once, whatever a text's length.
_PIECE = 1 << 16


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    ones, total = np.zeros(64, np.int64), len(words) - n + 1
    for at in range(0, total, _PIECE):
        part = words[at : at + _PIECE + n - 1]
        grams = zip(*(part[i:] for i in range(n)), strict=False)
        hashes = np.fromiter((xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int = SHINGLE, bands: bool = False) -> DataFrame:
    """(doc_id, fp): fp as a signed bigint; one row per input row. With
    ``bands`` also tid (the text's XXH64) and its band keys (null: no word)."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in slices(batches):
            texts = b.column(1).to_pylist()
            fps = np.fromiter((fingerprint(t, n) for t in texts), np.uint64, b.num_rows)
            cols, names = [b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"]
            if bands:
                tids = np.fromiter((xxh64_intdigest(t or "", SEED) for t in texts), np.uint64, b.num_rows)
                cols += [pa.array(tids.view(np.int64)), pa.array([band_keys(t) for t in texts], pa.list_(pa.int64()))]
                names += ["tid", "bands"]
            yield pa.RecordBatch.from_arrays(cols, names)

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return whole_texts(picked).mapInArrow(run, "doc_id bigint, fp bigint" + ", tid bigint, bands array<bigint>" * bands)


def _popcounts(fp: Column) -> Column:
    """Bit counts of the two-bit segments, still packed two bits each."""
    ones = 0x5555555555555555
    odd = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ones))
    even = fp.bitwiseAND(F.lit(ones))
    # per segment: low bit = xor, high bit = and, i.e. the sum as a binary number
    return odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))


def _axes() -> list[int]:
    """Bit masks of the axes: the segments dealt out in AXES runs."""
    n = 64 // SEGMENT_BITS
    cuts = [round(i * n / AXES) for i in range(AXES + 1)]
    return [sum(((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _manhattan(p: Column, q: Column) -> Column:
    """Manhattan distance of two packed points (coordinates 0, 1, 2)."""
    # Unary codes 00, 01, 11 differ in as many bits as the counts do.
    def unary(x: Column) -> Column:
        return x.bitwiseOR(F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x5555555555555555)))

    return F.bit_count(unary(p).bitwiseXOR(unary(q)))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct values of ``fp`` whose transitive closure is
    that of all pairs within RADIUS bits; every edge is within that distance."""
    point = _popcounts(F.col("fp"))
    masks = [_signed(sum(keep)) for keep in combinations(_axes(), AXES - RADIUS)]
    cells = fps.select("fp", point.alias("point")).select(
        "fp", "point", F.posexplode(F.array(*[F.col("point").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "coords")
    )
    cells = cells.select(F.xxhash64("choice", "coords").alias("cell"), "fp")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = materialize(sizes, "simhash-cells")
    shared = materialize(cells.join(sizes, "cell").select("cell", "n", "fp"), "simhash-shared")

    few = shared.filter(F.col("n") <= CROWD).select("cell", "fp")
    # one row a cell with at most CROWD members: pairs come from the array
    members = few.groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = members.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, CROWD)).alias("b"))
    close = (_manhattan(_popcounts(F.col("a")), _popcounts(F.col("b"))) <= RADIUS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    near = pairs.filter(close).distinct()

    crowd = shared.filter(F.col("n") > CROWD).select("fp").distinct()
    flips = [F.lit(0).cast("bigint")] + [F.lit(_signed(1 << i)).cast("bigint") for i in range(64)]
    balls = crowd.select("fp", F.explode(F.transform(F.array(*flips), lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    star = balls.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count(F.lit(1)).alias("n")).filter("a < z")
    star = materialize(star.select("mid", "a", "z", "n"), "simhash-stars")
    two = star.filter("n = 2").select("a", F.col("z").alias("b"))
    many = balls.join(star.filter("n > 2").select("mid", "a"), "mid").filter("fp > a").select("a", F.col("fp").alias("b"))
    return near.union(two).union(many).distinct()


# -- texts that share most of their shingles ----------------------------------

#: Words a shingle, and the share of common shingles (Jaccard) that links texts.
WIDE, SIMILAR = 5, 0.8
#: Band keys a text and minima a key: 0.9993 of the pairs at a similarity of
#: 0.8 share a key, 0.99999 at 0.85.
BANDS, MINIMA = 24, 6
#: A further round of stars is run while the last one linked this share of a
#: crowd's texts; then they are compared in blocks of BLOCK texts. Neither
#: decides what is linked.
GAIN, BLOCK = 0.5, 64

_GOLD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LANES = _mixed(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64) * np.uint64(_GOLD))


def shingles(text: str | None, n: int = WIDE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; of all words if fewer."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w, n = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), min(n, len(words))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(_GOLD) + w[i : len(w) - n + 1 + i]
    return np.unique(_mixed(out))


def band_keys(text: str | None) -> list[int] | None:
    s = shingles(text)
    if not len(s):
        return None
    low = np.full(len(_LANES), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[at : at + 2048, None] ^ _LANES) * (_LANES | np.uint64(1))).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, MINIMA).T:
        key = _mixed(key * np.uint64(_GOLD) + row)
    return key.view(np.int64).tolist()


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text ids that are similar, by the texts."""
    x = texts.select(F.col("tid").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("tid").alias("b"), F.col("text").alias("y"))

    def run(batches):
        last, own = None, None
        for batch in slices(batches):
            ids, ok = batch.column(0).to_pylist(), []
            xs, ys = batch.column(2), batch.column(3)
            for i, a in enumerate(ids):
                if a != last:
                    last, own = a, shingles(xs[i].as_py())
                ok.append(similarity(own, shingles(ys[i].as_py())) >= SIMILAR)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return whole_texts(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")).mapInArrow(run, "a bigint, b bigint")


def _crowd_pairs(crowd: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) of similar texts among all pairs that share a key of
    ``crowd`` (key, tid), but for pairs that ``found`` has in one component.

    A key's members are cut into blocks of BLOCK texts, in the order of their
    components, and each two blocks that are not of one component meet in a
    group of their own. A pair is verified under the smallest of its keys.
    """
    parts = fit(materialize(components(found), "crowd-parts"))
    placed = crowd.join(parts, F.col("tid") == F.col("node"), "left").select("key", "tid", F.coalesce("component", "tid").alias("c"))
    placed = materialize(placed, "crowd-placed")
    held = F.sum(F.xxhash64("tid").cast("decimal(20,0)")).alias("held")
    keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), held).filter("lo < hi")
    keys = fit(materialize(keys.groupBy("n", "held").agg(F.min("key").alias("key")).select("key"), "crowd-keys"))
    order = Window.partitionBy("key").orderBy("c", "tid")
    blocks = placed.join(keys, "key").select("key", "tid", "c", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int").alias("at"))
    blocks = materialize(blocks, "crowd-blocks")
    spans = materialize(blocks.groupBy("key", "at").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "crowd-spans")
    meet = spans.select("key", F.col("at").alias("i"), "lo").join(spans.select("key", F.col("at").alias("j"), "hi"), "key").filter("i <= j and lo < hi")
    meet = materialize(meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("at")), "crowd-meet")
    own = materialize(blocks.groupBy("tid").agg(F.collect_list("key").alias("keys")), "crowd-own")
    bodies = materialize(texts.join(own, "tid"), "crowd-bodies")
    rows = meet.join(blocks, ["key", "at"]).join(bodies, "tid").select("key", "i", "j", "at", "tid", "c", "keys", "text")

    def run(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(x)[0].as_py() for x in ("key", "i", "j"))
        at, tid, c = (table.column(x).to_pylist() for x in ("at", "tid", "c"))
        # pairs that share a smaller key are verified there
        less = [frozenset(k for k in ks if k < key) for ks in table.column("keys").to_pylist()]
        sets = [shingles(x.as_py()) for x in table.column("text")]
        sizes, root = np.array([len(s) for s in sets]), {x: x for x in c}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out: list[tuple[int, int]] = []
        left, right = [p for p, x in enumerate(at) if x == i], [p for p, x in enumerate(at) if x == j]
        for p in left:
            mine = find(c[p])
            with_ = [q for q in right if (i != j or q > p) and find(c[q]) != mine and less[p].isdisjoint(less[q]) and min(sizes[p], sizes[q]) >= SIMILAR * max(sizes[p], sizes[q])]
            if not with_:
                continue
            x, ys = sets[p], np.concatenate([sets[q] for q in with_])
            hit = x[np.minimum(np.searchsorted(x, ys), len(x) - 1)] == ys
            common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[with_])[:-1]]))
            for k in np.flatnonzero(common / (sizes[p] + sizes[with_] - common) >= SIMILAR):
                q = with_[k]
                out.append((tid[p], tid[q]))
                root[find(c[q])] = find(c[p])
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def similar_pairs(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Edges (a, b) of text ids whose texts are similar, each verified, with
    the components of all similar texts that share a band key.

    ``rows`` (tid, bands) are the fingerprinted ``docs``. A key of up to CROWD
    texts gives all its pairs. Of a larger one each text is first compared with
    the key's most central text (the one whose keys are shared most), in rounds
    without what is linked, which join most copies at linear cost; once a round
    links less than GAIN of them, all pairs that are in different components
    are compared in blocks.
    """
    uniq = materialize(rows.filter("bands is not null").groupBy("tid").agg(F.first("bands").alias("bands")), "similar-texts")
    cells = uniq.select("tid", F.explode("bands").alias("key"))
    sizes = materialize(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "similar-sizes")
    shared = materialize(cells.join(sizes, "key"), "similar-cells")
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tid"), F.col(text_col).cast("string").alias("text"))
    involved = fit(materialize(shared.select("tid").distinct(), "similar-ids"))
    texts = materialize(texts.join(involved, "tid", "left_semi").groupBy("tid").agg(F.max("text").alias("text")), "similar-bodies")

    members = shared.filter(F.col("n") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_list("tid")).alias("m"))
    pairs = members.select("m").distinct().select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, CROWD)).alias("b")).distinct()
    found = materialize(_verified(pairs, texts), "similar-links")

    weight = materialize(shared.groupBy("tid").agg(F.sum("n").alias("w")), "similar-weights")
    crowd = rest = materialize(shared.filter(F.col("n") > CROWD).select("key", "tid").join(weight, "tid"), "similar-crowds")
    if crowd.isEmpty():
        return found
    left = rest.select("tid").distinct().count()
    while left:
        lead = rest.groupBy("key").agg(F.max(F.struct("w", "tid")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        lead = materialize(lead.select("key", F.col("l.tid").alias("a")), "similar-leads")
        tried = rest.join(lead, "key").filter("a <> tid").select("a", F.col("tid").alias("b")).distinct()
        got = materialize(_verified(tried, texts), "similar-round")
        found = found.union(got)
        done = got.select(F.col("b").alias("tid")).union(lead.select(F.col("a").alias("tid"))).distinct()
        rest = materialize(rest.join(done, "tid", "left_anti"), "similar-crowds")
        now = rest.select("tid").distinct().count()
        if left - now < GAIN * left:
            break
        left = now
    return found.union(materialize(_crowd_pairs(crowd.select("key", "tid"), found, texts), "similar-crowded"))


# -- operators ---------------------------------------------------------------


def _labelled(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of fingerprinted rows (doc_id, fp): the smallest id
    reachable over links of RADIUS bits."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    linked = materialize(components(links(distinct)), "simhash-linked")
    # components are labelled by a fingerprint; relabel by the smallest id
    member = distinct.join(linked, distinct.fp == linked.node).select("fp", "rep", "component")
    member = materialize(member, "simhash-members")
    label = materialize(member.groupBy("component").agg(F.min("rep").alias("smallest")), "simhash-labels")
    member = member.join(label, "component").select("fp", "smallest")
    named = distinct.join(member, "fp", "left").select("fp", F.coalesce("smallest", "rep").alias("component_id"))
    return materialize(named, "simhash-named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of non-blank characters after A-Z is lower-cased; shingles
    are ``n`` words, repeats counted; a bit is set if it is set in over half of
    the shingles' XXH64 (seed 42). Rows whose fingerprints differ in RADIUS
    bits at most are linked; component_id is the smallest id reachable.

    Edge cases: null, empty and blank texts have fingerprint 0 and link like
    any other; texts of fewer than ``n`` words are one shingle; equal texts and
    repeated rows share a component; a null id is kept, ignored as the smallest
    id unless its whole component has none; an empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, n), "simhash-fps")
    named = _labelled(rows)
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, unchanged, of each group's smallest id.

    A group is what links of two kinds connect: fingerprints within RADIUS bits
    (as in :func:`near_duplicates`), and texts that share SIMILAR of their
    WIDE-word shingles. Rows that share an id stay or go together; rows without
    an id go if their group has an id and stay otherwise.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, n, bands=True), "simhash-rows")
    named = _labelled(rows.select("doc_id", "fp"))
    placed = materialize(rows.select("doc_id", "tid", "fp").join(named, "fp").select("doc_id", "tid", "component_id"), "simhash-placed")
    groups = materialize(placed.filter("component_id is not null").groupBy("tid").agg(F.min("component_id").alias("c")), "simhash-groups")
    pairs = materialize(similar_pairs(rows.select("tid", "bands"), docs, text_col), "similar-found")
    ends = pairs.join(groups.select(F.col("tid").alias("a"), F.col("c").alias("u")), "a").join(groups.select(F.col("tid").alias("b"), F.col("c").alias("v")), "b")
    merged = materialize(components(ends.filter("u <> v"), "u", "v"), "simhash-merged").withColumnRenamed("component", "least")
    placed = placed.join(fit(merged), F.col("component_id") == F.col("node"), "left").select("doc_id", F.coalesce("least", "component_id").alias("keep"))
    gone = placed.filter("not (doc_id <=> keep)").select(F.col("doc_id").alias("__gone")).distinct()
    gone = fit(materialize(gone, "simhash-gone"))
    return docs.join(gone, F.col(id_col).cast("bigint").eqNullSafe(gone["__gone"]), "left_anti")
