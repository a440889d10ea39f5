"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraph pieces (lines; a line also ends at ". ", "! ", "? "
or an ideographic stop, so that one-paragraph texts resolve too; a piece of over
LONG bytes is cut where the eight bytes before a character say so). Each piece becomes a 64-bit
digest that includes how often it has occurred before in the text, which makes
the multiset a set. A sketch has CELLS cells of (count, xor of digests, xor of
check hashes); a digest goes to one cell in each of three thirds.

Two versions' sketches subtract cell by cell: what they share cancels, and
peeling cells that hold a single digest recovers the digests on either side.
Where too many differ to peel, both are sketched again with more cells (enough
for all digests to differ, then twice as many each time) and other positions
until peeling succeeds.

The likeness of two fingerprints is shared / (shared + removed + added), the
Jaccard similarity of the digest sets, exact up to hash collisions; 1 for two
empty texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, id_bounds, shuffle_partitions, whole_texts

CELLS = 24
_THIRDS = 3
#: Levels after which (never, short of colliding digests) sets are compared.
MAX_LEVELS = 8
#: Texts sketched together, and the characters after which a group is closed.
GROUP_ROWS, GROUP_CHARS = 1024, 1 << 21


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, by seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 1_000_003) & np.uint64(0xFFFFFFFF)


def _places(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cell numbers within a sketch of so many cells, one row for each third."""
    third = (cells // _THIRDS).astype(np.uint64)
    seed = _mix(cells.astype(np.uint64), 3)
    h = _mix(keys ^ seed, 8)
    out = []
    for i in range(_THIRDS):
        part = (h >> np.uint64(21 * i)) & np.uint64(0x1FFFFF)
        out.append(((part * third) >> np.uint64(21)).astype(np.int64) + (third * np.uint64(i)).astype(np.int64))
    return np.stack(out)


#: Longer pieces are cut at about one byte in LONG_CUT, wherever they stand.
LONG, LONG_CUT = 768, 128
_STOPS = tuple(x.encode() for x in "\u3002\uff01\uff1f")


def pieces(text: str | None) -> list[bytes]:
    """The paragraph pieces of a text; joined, they are its UTF-8 bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass").replace(b"\n", b"\n\xff")
    for end in (b". ", b"! ", b"? "):
        raw = raw.replace(end, end[:1] + b"\xff ")
    for end in _STOPS:
        raw = raw.replace(end, end + b"\xff")
    out = raw.split(b"\xff")
    if len(raw) > LONG and max(map(len, out)) > LONG:
        return [x for p in out for x in (_cut(p) if len(p) > LONG else [p]) if x]
    return [p for p in out if p]


def _cut(piece: bytes) -> list[bytes]:
    """A long piece in parts that depend on the bytes around their ends alone."""
    b = np.frombuffer(piece, np.uint8)
    window = np.zeros(len(b) - 7, np.uint64)  # the eight bytes from here
    for i in range(8):
        window = (window << np.uint64(8)) | b[i : len(b) - 7 + i]
    at = np.flatnonzero(_mix(window, 11) % np.uint64(LONG_CUT) == 0) + 8
    at = at[at < len(b)]
    at = at[(b[at] & 0xC0) != 0x80].tolist()
    return [piece[s:e] for s, e in zip([0, *at], [*at, len(b)], strict=True)]


def digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of all pieces of some texts, sorted by row."""
    from xxhash import xxh3_64_intdigest

    raw = [[xxh3_64_intdigest(p) for p in pieces(t)] for t in texts]
    n = np.array([len(r) for r in raw])
    row = np.repeat(np.arange(len(texts)), n)
    h = np.fromiter((x for r in raw for x in r), np.uint64, int(n.sum()))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    before = np.arange(len(h)) - start[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return row, _mix(h, 0) if not len(h) else _mix(h ^ _mix(before.astype(np.uint64), 5), 0)


def sketch(row: np.ndarray, keys: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, digests' xor, checks' xor) of rows with ``cells[row]`` cells
    each, one row's cells after the other's."""
    total, start = int(cells.sum()), np.cumsum(cells) - cells
    count = np.zeros(total, np.int64)
    xor, check = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    checks = _check(keys)
    for place in _places(keys, cells[row]):
        at = start[row] + place
        count += np.bincount(at, minlength=total)
        np.bitwise_xor.at(xor, at, keys)
        np.bitwise_xor.at(check, at, checks)
    return count, xor, check


def peel(count: np.ndarray, xor: np.ndarray, check: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel difference sketches laid out as by :func:`sketch`. Returns which
    rows came out empty, and (row, digest, sign) of what was recovered: +1 of
    the first version."""
    start = np.cumsum(cells) - cells
    owner = np.repeat(np.arange(len(cells)), cells)
    count, xor, check = count.copy(), xor.copy(), check.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.arange(len(count))
    for _ in range(len(count) + 8):
        # only cells that the last round touched can have become pure
        one = at[np.abs(count[at]) == 1]
        pure = one[check[one] == _check(xor[one])]
        if not len(pure):
            break
        row, key, sign = owner[pure], xor[pure], count[pure]
        _, first = np.unique(key ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        row, key, sign = row[first], key[first], sign[first]
        places, checks = start[row] + _places(key, cells[row]), _check(key)
        own = (places == pure[first]).any(axis=0)
        if not own.all():
            row, key, sign, places, checks = row[own], key[own], sign[own], places[:, own], checks[own]
        if not len(row):
            break
        found.append((row, key, sign))
        for at in places:
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(xor, at, key)
            np.bitwise_xor.at(check, at, checks)
        at = places.ravel()
    left = np.bincount(owner, weights=(count != 0) | (xor != 0), minlength=len(cells))
    if not found:
        none = np.zeros(0, np.int64)
        return left == 0, none, np.zeros(0, np.uint64), none
    return left == 0, *(np.concatenate([f[i] for f in found]) for i in range(3))


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n_rows: int, base=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, sign, cells of each row's successful sketch) between two
    groups of versions, row by row. ``base``: their sketches of CELLS cells."""
    todo = np.arange(n_rows)
    used = np.zeros(n_rows, np.int64)
    cells = np.full(n_rows, CELLS, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    (ra, ka), (rb, kb) = a, b
    for level in range(MAX_LEVELS):
        sa, sb = base if base and not level else (sketch(ra, ka, cells), sketch(rb, kb, cells))
        ok, row, key, sign = peel(sa[0] - sb[0], sa[1] ^ sb[1], sa[2] ^ sb[2], cells)
        good = ok[row]
        out.append((todo[row[good]], key[good], sign[good]))
        used[todo[ok]] = cells[ok]
        if ok.all():
            break
        # again for those that did not come out empty, with cells for the case
        # that all digests differ, and from then on twice as many each time
        left = np.flatnonzero(~ok)
        place = np.full(len(todo), -1)
        place[left] = np.arange(len(left))
        ka, ra = ka[place[ra] >= 0], place[ra][place[ra] >= 0]
        kb, rb = kb[place[rb] >= 0], place[rb][place[rb] >= 0]
        todo, cells = todo[left], 2 * cells[left]
        if not level:
            most = np.bincount(ra, minlength=len(left)) + np.bincount(rb, minlength=len(left))
            cells = np.maximum(cells, _THIRDS * (most * 29 // 60 + 8))
    else:
        for i, row in enumerate(todo):
            x, y = set(ka[ra == i].tolist()), set(kb[rb == i].tolist())
            for side, sign in ((x - y, 1), (y - x, -1)):
                out.append((np.full(len(side), row), np.array(sorted(side), np.uint64), np.full(len(side), sign)))
    return *(np.concatenate([o[i] for o in out]) for i in range(3)), used


def likeness(n_a: np.ndarray, n_b: np.ndarray, removed: np.ndarray) -> np.ndarray:
    shared = n_a - removed
    union = n_a + n_b - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def encode(count: np.ndarray, xor: np.ndarray, check: np.ndarray, n: np.ndarray) -> list[str]:
    """Fingerprints as base64: digests (u32), then cells of count (u16, modulo
    2**16), digests' xor (u64) and checks' xor (u32), little-endian."""
    rows = np.zeros((len(n), CELLS), np.dtype([("c", "<u2"), ("x", "<u8"), ("k", "<u4")]))
    rows["c"], rows["x"], rows["k"] = (v.reshape(-1, CELLS) for v in (count & 0xFFFF, xor, check))
    head = n.astype("<u4")
    return [base64.b64encode(head[i].tobytes() + rows[i].tobytes()).decode() for i in range(len(n))]


def decode(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(digests, counts modulo 2**16, digests' xor, checks' xor)."""
    raw = base64.b64decode(fingerprint)
    cells = np.frombuffer(raw, np.dtype([("c", "<u2"), ("x", "<u8"), ("k", "<u4")]), offset=4)
    return int.from_bytes(raw[:4], "little"), cells["c"].astype(np.int64), cells["x"].astype(np.uint64), cells["k"].astype(np.uint64)


class Group:
    """Digests and base sketches of some texts."""

    def __init__(self, texts: list[str | None]):
        self.n = len(texts)
        self.row, self.key = digests(texts)
        self.size = np.bincount(self.row, minlength=self.n)
        self.base = sketch(self.row, self.key, np.full(self.n, CELLS))

    def strings(self) -> list[str]:
        return encode(*self.base, self.size)

    def part(self, start: int, stop: int) -> Group:
        out = object.__new__(Group)
        keep = (self.row >= start) & (self.row < stop)
        out.n, out.row, out.key, out.size = stop - start, self.row[keep] - start, self.key[keep], self.size[start:stop]
        out.base = tuple(x[start * CELLS : stop * CELLS] for x in self.base)
        return out

    def against(self, other: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(likeness, removed, added) by row."""
        row, _, sign, _ = differences((self.row, self.key), (other.row, other.key), self.n, (self.base, other.base))
        removed = np.bincount(row[sign > 0], minlength=self.n)
        added = np.bincount(row[sign < 0], minlength=self.n)
        return likeness(self.size, other.size, removed), removed, added


def recover_differences(pairs: DataFrame, old: str = "old", new: str = "new", key: str = "doc_id") -> DataFrame:
    """(key, removed, added): the digests of paragraph pieces that only the old
    or only the new text of a row has, recovered by subtracting and peeling.

    Null texts are empty; equal texts give two empty arrays; rows may repeat.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                a, b = (Group(part.column(i).to_pylist()) for i in (1, 2))
                row, dig, sign, _ = differences((a.row, a.key), (b.row, b.key), part.num_rows, (a.base, b.base))
                lists: list[list[list[int]]] = [[[] for _ in range(part.num_rows)] for _ in range(2)]
                for r, d, s in zip(row.tolist(), dig.view(np.int64).tolist(), sign.tolist(), strict=True):
                    lists[s < 0][r].append(d)
                arrays = [pa.array([sorted(x) for x in side], pa.list_(pa.int64())) for side in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], [key, "removed", "added"])

    picked = pairs.select(key, F.col(old).cast("string").alias("o"), F.col(new).cast("string").alias("n"))
    kind = dict(pairs.dtypes)[key]
    return whole_texts(picked).mapInArrow(run, f"`{key}` {kind}, removed array<bigint>, added array<bigint>")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, part, peek): rows in ascending id, dealt to parts by id
    ranges; each part ends with a copy (peek) of the row that follows it."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds = id_bounds(rows, "doc_id", n)
    last = len(bounds)
    part = bucket_of(F.col("doc_id"), bounds)
    ends = rows.agg(F.min("doc_id").alias("lo"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    # A part's first id is its bound; the very first row follows the last part.
    heads = F.when(F.col("doc_id").isin(bounds) if bounds else F.lit(False), F.array(part, part - 1))
    if not ends["nulls"] and ends["lo"] is not None:
        heads = F.when(F.col("doc_id") == ends["lo"], F.array(part, F.lit(last))).otherwise(heads)
    spread = rows.select("doc_id", "text", part.alias("own"), F.explode(F.coalesce(heads, F.array(part))).alias("part"), F.lit(0).alias("zero"))
    if last == 0:
        spread = rows.select("doc_id", "text", F.lit(0).alias("part"), F.lit(False).alias("peek"))
        if not ends["nulls"] and ends["lo"] is not None:
            spread = spread.union(spread.filter(F.col("doc_id") == ends["lo"]).withColumn("peek", F.lit(True)))
    else:
        spread = spread.select("doc_id", "text", "part", (F.col("part") != F.col("own")).alias("peek"))
    if ends["nulls"]:
        first = rows.filter("doc_id is null").orderBy(F.col("text").asc_nulls_first()).limit(1)
        spread = spread.union(first.select("doc_id", "text", F.lit(last).alias("part"), F.lit(True).alias("peek")))
    spread = spread.repartitionById(last + 1, "part")
    return spread.sortWithinPartitions("part", "peek", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, pieces bigint, edited_removed bigint, edited_added bigint"


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the following text's first
    as many (or all)."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _emit(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results of all but the last text, which only follows."""
    n = len(texts) - 1
    own = Group(texts)
    changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
    new, a, b = Group(changed), own.part(0, n), own.part(1, n + 1)
    near, removed, added = a.against(new)
    nxt, _, _ = a.against(b)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array(a.strings()),
            pa.array(new.strings()),
            pa.array(near),
            pa.array(nxt),
            pa.array(a.size.astype(np.int64)),
            pa.array(removed.astype(np.int64)),
            pa.array(added.astype(np.int64)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "pieces", "edited_removed", "edited_added"],
    )


def _pairwise(batches: Iterator[pa.RecordBatch], emit: Callable[[list, list[str]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream over the sorted parts, a few texts at a time."""
    ids, texts, chars, part, closed = [], [], 0, None, False
    for batch in batches:
        cols = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            own = cols[2][i].as_py()
            if own != part:
                if len(texts) > 1:
                    yield emit(ids, texts)
                ids, texts, chars, part, closed = [], [], 0, own, False
            if closed:
                continue  # further rows with the id of the row that follows
            text = cols[1][i].as_py() or ""
            ids.append(cols[0][i].as_py())
            texts.append(text)
            chars += len(text)
            closed = cols[3][i].as_py()
            if len(texts) > GROUP_ROWS or chars > GROUP_CHARS or closed:
                if len(texts) > 1:
                    yield emit(ids, texts)
                ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield emit(ids, texts)


def version_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited version of it (its second
    half replaced by the start of the next document's), and likenesses.

    Edge cases: a null text is empty; empty texts have the sketch of no piece
    and likeness 1 to each other, 0 to others; the only row's next document is
    itself; rows are ordered by id (nulls first), then text, and repeated rows
    each count; an empty table gives no rows. Other columns are ignored.
    """
    def run(batches):
        yield from _pairwise(batches, _emit)

    return whole_texts(in_order(docs, id_col, text_col)).mapInArrow(run, SCHEMA)
