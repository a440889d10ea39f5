"""Token ids as Simple-8b: word-aligned coding with vectorised decoding.

A 64-bit word holds a 4-bit selector on top and below it as many ids as the
selector says, of equal width, first id lowest. Selector 0 is the escape: the
word's low 60 bits count raw 64-bit words that follow, for ids of over 60 bits.
Ids are packed greedily (most ids first) within blocks of BLOCK ids; the offset
of each block's first word is kept, so blocks decode alone and at once.

A segment is one self-describing byte string of whole documents:

    magic "S8W1" | u32 block size | u64 ids | u32 documents | u32 blocks |
    u32 words | u32 first word of each block | u32 ids of each document |
    u8 validity, i64 id of each document | u64 words

all little-endian. A token file set is a Parquet folder of segments with
(part, seq, first, n_ids, payload): Spark's writers commit it on any file
system, and a range of ids is found from the other columns alone.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, id_bounds, long_array, shuffle_partitions, whole_texts

MAGIC = b"S8W1"
BLOCK = 4096
#: (ids, bits) by selector; 0 is the escape.
SELECTORS = [(0, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_ESCAPED = 255
#: Ids after which a segment is closed (at the end of a document).
SEGMENT_IDS = 1 << 19
END_ID = 2


#: Class of an id: the first selector (from 1) whose width holds it; 16 if none.
_LIMITS = np.array([(1 << b) - 1 for _, b in SELECTORS[1:]], np.uint64)
_CLASS = (np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="left") + 1).astype(np.uint8)

_STEP = np.array([max(1, c) for c, _ in SELECTORS], np.uint8)
#: Ids packed together: some blocks; and how many ids are left in the block.
_AT_ONCE = 16 * BLOCK
_LEFT = np.minimum(BLOCK - np.arange(_AT_ONCE) % BLOCK, 255).astype(np.uint8)

# -- coding ------------------------------------------------------------------


def _choices(ids: np.ndarray) -> np.ndarray:
    """Selector of a word that starts at each position of one or more blocks."""
    if int(ids.max()) < len(_CLASS):
        need = _CLASS[ids]
    else:
        need = (np.searchsorted(_LIMITS, ids, side="left") + 1).astype(np.uint8)
    n = len(ids)
    left = np.minimum(_LEFT[:n], np.minimum(n - np.arange(n), 255).astype(np.uint8))
    out = np.full(n, 0, np.uint8)
    run, width = need.copy(), 1
    for sel in range(15, 0, -1):
        count = SELECTORS[sel][0]
        while width < count:  # widest class in the next `count` ids, by doubling
            step = min(width, count - width)
            run[:-step] = np.maximum(run[:-step], run[step:]) if step < n else run[:-step]
            width += step
        fits = (run <= sel) & (left >= count)
        if not fits.any():
            if count > 8:
                break
            continue
        np.putmask(out, fits, np.uint8(sel))
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of non-negative ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    words, blocks, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], 0
    for s in range(0, len(ids), _AT_ONCE):  # in pieces that stay in the cache
        w, b = _pack(ids[s : s + _AT_ONCE])
        words.append(w)
        blocks.append(b + np.uint32(at))
        at += len(w)
    return np.concatenate(words), np.concatenate(blocks)


def _pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    sel = _choices(ids)
    step = _STEP[sel].tobytes()
    starts, at = [], 0
    push = starts.append
    while at < n:
        push(at)
        at += step[at]
    start = np.array(starts, np.int64)
    chosen = sel[start]
    # an escape takes a word for the count and one for the id
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.flatnonzero(np.bincount(chosen, minlength=16)).tolist():
        count, bits = SELECTORS[s]
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            words[place[mine]] = 1
            words[place[mine] + 1] = ids[start[mine]]
            continue
        word, first = np.full(len(mine), s << 60, np.uint64), start[mine]
        for i in range(count if bits else 0):
            word |= ids[first + i] << np.uint64(i * bits)
        words[place[mine]] = word
    first = np.searchsorted(start, np.arange(0, n, BLOCK))
    return words, place[first].astype(np.uint32)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of some words, from the start of a block."""
    words = np.ascontiguousarray(words, np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[sel]
    escapes = sel == 0
    if escapes.any():
        # walk the escapes in order: raw words look like anything
        at = 0
        for i in np.flatnonzero(escapes).tolist():
            if i < at:
                continue
            raw = int(words[i]) & ((1 << 60) - 1)
            counts[i], sel[i] = 0, -1
            counts[i + 1 : i + 1 + raw], sel[i + 1 : i + 1 + raw] = 1, _ESCAPED
            at = i + 1 + raw
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        if s < 2:
            continue
        mine = np.flatnonzero(sel == s)
        mask = np.uint64((1 << bits) - 1)
        for i in range(count if len(mine) else 0):
            out[place[mine] + i] = (words[mine] >> np.uint64(i * bits)) & mask
    raw = np.flatnonzero(sel == _ESCAPED)
    out[place[raw]] = words[raw]
    return out


def segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """Documents' ids as one segment."""
    counts = np.array([len(d) for d in docs], "<u4")
    words, blocks = pack(np.concatenate(docs) if docs else np.zeros(0, np.uint64))
    head = struct.pack("<4sIQIII", MAGIC, BLOCK, int(counts.sum()), len(docs), len(blocks), len(words))
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    own = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, blocks.astype("<u4").tobytes(), counts.tobytes(), valid.tobytes(), own.tobytes(), words.astype("<u8").tobytes()])


class Segment:
    """A decoded view of a segment's tables; ids on demand."""

    def __init__(self, payload: bytes):
        magic, self.block, self.n_ids, n_docs, n_blocks, n_words = struct.unpack_from("<4sIQIII", payload)
        if magic != MAGIC:
            raise ValueError("not a Simple-8b segment")
        at = struct.calcsize("<4sIQIII")
        take = lambda dtype, n: np.frombuffer(payload, dtype, n, at)
        self.blocks = take("<u4", n_blocks)
        at += 4 * n_blocks
        self.counts = take("<u4", n_docs)
        at += 4 * n_docs
        valid = take("u1", n_docs)
        at += n_docs
        own = take("<i8", n_docs)
        at += 8 * n_docs
        self.doc_ids = [int(d) if v else None for d, v in zip(own, valid, strict=True)]
        self.words = take("<u8", n_words)
        if len(payload) != at + 8 * n_words:
            raise ValueError("a Simple-8b segment is cut short or too long")

    def ids(self) -> np.ndarray:
        return unpack(self.words)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop), decoding only the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint64)
        a, b = start // self.block, -(-stop // self.block)
        end = self.blocks[b] if b < len(self.blocks) else len(self.words)
        got = unpack(self.words[self.blocks[a] : end])
        return got[start - a * self.block : stop - a * self.block]


# -- tokenizing --------------------------------------------------------------


class Words(dict):
    """Ids of whitespace-delimited words by a tokenizer that never looks across
    white space, as bytes of u32; filled as words come up, emptied when full.

    Words of plain letters go to the model without the regular expressions
    around it, which is many times faster, and share their lower-case form's
    entry with or without a full stop after them; all others go through the
    whole tokenizer. Both are checked against it in the tests.
    """

    MOST, RENEW = 1_000_000, 16
    PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-įı-ňŊ-ž]+)([.,;:!?]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.missed = 0
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.byte_chars = [chr(b) if b in kept else chr(next(spare)) for b in range(256)]
        pre = self.tok.pre_tokenizer.pre_tokenize_str
        # the letters' shortcut holds for lower-casing byte-level models
        low = self.tok.encode("ABCé", add_special_tokens=False).ids
        self.fast = low == self._model_ids("abcé") and [p for p, _ in pre("abc")] == ["abc"]

    def _model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_chars))]

    def __missing__(self, word: str) -> bytes:
        """First come, first kept: frequent words come first. A full table that
        has missed RENEW times its size starts anew, as the text has changed."""
        if not word:
            return b""
        if self.fast and word.isascii() and word.isalpha() and word.islower():
            out = array("I", self._model_ids(word)).tobytes()
        elif not (plain := self.fast and self.PLAIN.fullmatch(word)):
            out = array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        elif (stem := plain[1].lower()) != word:
            out = self[stem] + (self[plain[2]] if plain[2] else b"")
        else:
            out = array("I", self._model_ids(word)).tobytes()
        if len(self) < self.MOST:
            self[word] = out
        else:
            self.missed += 1
            if self.missed > self.RENEW * self.MOST:
                self.missed = 0
                self.clear()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); a null text has none.

        Split and counted in C++; Python sees each distinct word once.
        """
        split = pc.ascii_split_whitespace(texts)
        words = pc.list_flatten(split).dictionary_encode()
        ids = pa.array([self[w] for w in words.dictionary.to_pylist()], pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        per_text = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        upto = ends[np.cumsum(per_text)]
        flat = np.frombuffer(data, "<u4") if len(ids) and data else np.zeros(0, "<u4")
        return flat[: ends[-1]], np.diff(upto, prepend=0)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids :meth:`encode` makes of each text."""
        split = pc.ascii_split_whitespace(texts)
        words = pc.list_flatten(split).dictionary_encode()
        size = np.fromiter((len(self[w]) // 4 for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[words.indices.to_numpy(zero_copy_only=False)])])
        return np.diff(upto[np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))], prepend=0)


_words: dict[str, Words] = {}


def words_for(path: str) -> Words:
    """The word table of a tokenizer file, one a Python worker."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


# -- files -------------------------------------------------------------------

#: Bytes of text encoded at once.
GROUP_BYTES = 8 << 20


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, rows) of runs of texts of about GROUP_BYTES."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + GROUP_BYTES, side="right")))
        yield start, stop - start
        start = stop


def regrouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, ...) in batches of about GROUP_BYTES of text, whatever
    size they come in: the more words at once, the more of them are the same."""
    held, size = [], 0
    for batch in batches:
        for at in _groups(batch.column(1)):
            part = batch.slice(*at)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if size >= GROUP_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


FILE_SCHEMA = "part int, seq int, first bigint, n_ids bigint, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode all texts and write them as a token file set in ascending id.

    Parts are id ranges, so part order is id order; within a part documents
    stand by id, then text (nulls first). A null text is empty: only the end
    id. An empty table writes an empty set.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds = id_bounds(rows, "doc_id", shuffle_partitions(spark))
    rows = rows.withColumn("part", bucket_of(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, "part")
    rows = rows.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = words_for(tokenizer), np.array([end_id], "<u4")
        part, seq, first, ids, docs_, n = None, 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            cols = [[part], [seq], [first], [n], [segment(ids, docs_)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "seq", "first", "n_ids", "payload"])

        for sub in regrouped(batches):
            flat, counts = table.encode(sub.column(1))
            ends = np.cumsum(counts)
            for i, (stop, k) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                own = sub.column(2)[i].as_py()
                if ids and (own != part or n >= SEGMENT_IDS):
                    yield close()
                    seq, first = (seq + 1, first + n) if own == part else (0, 0)
                    ids, docs_, n = [], [], 0
                part = own
                ids.append(sub.column(0)[i].as_py())
                docs_.append(np.concatenate([flat[stop - k : stop], end]))
                n += k + 1
        if ids:
            yield close()

    whole_texts(rows.select("doc_id", "text", "part")).mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """Documents of a token file set: doc_id, start (ids of all documents
    before it), n_tokens, and ids_crc32 (of the ids as u32) or the ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, seen = [], 0
    for part in range(max(sums, default=-1) + 1):
        base.append(seen)
        seen += sums.get(part, 0)
    start = F.get(long_array(base), F.col("part")) + F.col("first") if base else F.col("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch.column(1)[i].as_py())
                ids = seg.ids().astype("<u4")
                ends = np.cumsum(seg.counts, dtype=np.int64)
                begins = ends - seg.counts
                raw = memoryview(ids.tobytes())
                if digest:
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int64()))
                own = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(begins + own), pa.array(seg.counts.astype(np.int64)), last], ["doc_id", "start", "n_tokens", "ids"])

    kind = "bigint" if digest else "array<bigint>"
    out = whole_texts(files.select(start.alias("start"), "payload")).mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, ids {kind}")
    return out.withColumnRenamed("ids", "ids_crc32") if digest else out
