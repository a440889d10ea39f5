"""Binary formats: xorbs (runs of framed chunks) and metadata shards."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from .. import constants as c
from .bits import CodecError, compress, decompress


class FormatError(ValueError):
    """Bytes that are not a xorb or shard."""


# -- xorbs: [version u8 | packed size u24 | codec u8 | size u24 | bytes] ...


def chunk_header(packed: int, codec: int, size: int) -> bytes:
    if not (0 <= packed < 1 << 24 and 0 <= size < 1 << 24):
        raise FormatError("InvalidChunkSize")
    return struct.pack("<II", c.XORB_VERSION | packed << 8, codec | size << 8)


def parse_header(raw: bytes) -> tuple[int, int, int, int]:
    """(version, packed size, codec number, size)."""
    a, b = struct.unpack_from("<II", raw)
    return a & 0xFF, a >> 8, b & 0xFF, b >> 8


def serialize_xorb(chunks: Iterable[bytes], codec: str = "lz4") -> tuple[bytes, list[tuple[int, int]]]:
    """The xorb and each chunk's [start, end) in it."""
    out, spans, at = [], [], 0
    for data in chunks:
        packed, number = compress(data, codec)
        out += [chunk_header(len(packed), number, len(data)), packed]
        spans.append((at, at + c.CHUNK_HEADER + len(packed)))
        at = spans[-1][1]
    return b"".join(out), spans


@dataclass
class Frame:
    index: int
    start: int
    end: int
    codec: int
    size: int
    raw: memoryview

    def data(self) -> bytes:
        return decompress(bytes(self.raw), self.codec, self.size)


def frames(payload: bytes) -> Iterator[Frame]:
    """The framed chunks of a xorb, not yet decompressed."""
    view, at, index = memoryview(payload), 0, 0
    while at < len(view):
        if at + c.CHUNK_HEADER > len(view):
            raise FormatError("TruncatedXorb")
        version, packed, codec, size = parse_header(view[at : at + c.CHUNK_HEADER])
        if version != c.XORB_VERSION:
            raise FormatError("UnsupportedVersion")
        if codec >= len(c.CODECS):
            raise CodecError(f"InvalidCompressionType: {codec}")
        if size == 0 and packed > 0:
            raise FormatError("InvalidChunkSize")
        end = at + c.CHUNK_HEADER + packed
        if end > len(view):
            raise FormatError("TruncatedXorb")
        yield Frame(index, at, end, codec, size, view[at + c.CHUNK_HEADER : end])
        at, index = end, index + 1


def chunk_at(payload: bytes, index: int) -> bytes:
    """Bytes of one chunk; decodes no other."""
    for f in frames(payload):
        if f.index == index:
            return f.data()
    raise FormatError("ChunkNotFound")


def chunk_range(payload: bytes, start: int, stop: int) -> bytes:
    """Bytes of chunks [start, stop); decodes no others."""
    if start >= stop:
        raise FormatError("InvalidRange")
    out = []
    for f in frames(payload):
        if f.index >= stop:
            break
        if f.index >= start:
            out.append(f.data())
    if len(out) < stop - start:
        raise FormatError("RangeOutOfBounds")
    return b"".join(out)


# -- shards ------------------------------------------------------------------

_HEADER = struct.Struct("<32sQQ")
_FOOTER = struct.Struct("<QQQ48x32sQQ72xQ")
_FILE = struct.Struct("<32sII8x")
_SEGMENT = struct.Struct("<32sIIII")
_RANGE = struct.Struct("<32s16x")
_XORB = struct.Struct("<32sIIII")
_CHUNK = np.dtype([("hash", "V32"), ("start", "<u4"), ("size", "<u4"), ("pad", "<u8")])
#: Any entry: a hash and four words.
_ENTRY = np.dtype([("hash", "u1", 32), ("w", "<u4", 4)])


def _u32(n: int) -> int:
    if not 0 <= n < 1 << 32:
        raise FormatError("a size does not fit 32 bits")
    return n


@dataclass
class FileInfo:
    """A file: its segments as (xorb hash, size, first chunk, end chunk), and
    the hash over its chunk hashes, if it has one."""

    file_hash: bytes
    segments: Sequence[tuple[bytes, int, int, int]]
    range_hash: bytes | None = None


@dataclass
class XorbInfo:
    """A xorb: its chunks as (hash, raw offset, size)."""

    xorb_hash: bytes
    chunks: Sequence[tuple[bytes, int, int]]
    raw_bytes: int
    stored_bytes: int


@dataclass
class Shard:
    files: list[FileInfo] = field(default_factory=list)
    xorbs: list[XorbInfo] = field(default_factory=list)
    key: bytes = c.ZERO
    created: int = 0
    expires: int = 0
    file_offset: int = 0
    xorb_offset: int = 0
    footer_offset: int = 0

    @property
    def is_keyed(self) -> bool:
        return self.key != c.ZERO

    def to_bytes(self) -> bytes:
        files, xorbs = [], []
        for f in self.files:
            files.append(_FILE.pack(f.file_hash, 0 if f.range_hash is None else c.HAS_VERIFICATION, len(f.segments)))
            files += [_SEGMENT.pack(h, 0, _u32(size), _u32(a), _u32(b)) for h, size, a, b in f.segments]
            if f.range_hash is not None:
                files.append(_RANGE.pack(f.range_hash))
        for x in self.xorbs:
            xorbs.append(_XORB.pack(x.xorb_hash, 0, len(x.chunks), _u32(x.raw_bytes), _u32(x.stored_bytes)))
            rows = np.zeros(len(x.chunks), _CHUNK)
            for i, (h, start, size) in enumerate(x.chunks):
                rows[i] = (np.void(h), _u32(start), _u32(size), 0)
            xorbs.append(rows.tobytes())
        head = _HEADER.pack(c.SHARD_TAG, c.SHARD_VERSION, c.SHARD_FOOTER)
        file_part, xorb_part = b"".join(files) + c.BOOKEND, b"".join(xorbs) + c.BOOKEND
        at = len(head) + len(file_part)
        end = at + len(xorb_part)
        return head + file_part + xorb_part + _FOOTER.pack(c.FOOTER_VERSION, len(head), at, self.key, self.created, self.expires, end)


class ShardFold:
    """A shard written while its rows arrive, sorted by section (files, then
    xorbs), hash and index: 48 bytes an entry are all that is held."""

    def __init__(self, key: bytes = c.ZERO, created: int = 0, expires: int = 0) -> None:
        self.key, self.created, self.expires = key, created, expires
        self.out = bytearray(_HEADER.pack(c.SHARD_TAG, c.SHARD_VERSION, c.SHARD_FOOTER))
        self.xorb_at = 0  # none until the file section is ended
        self.own: bytes | None = None
        self.own_at, self.range_hash = 0, None

    def _end_own(self) -> None:
        if self.range_hash is not None:
            self.out += _RANGE.pack(self.range_hash)
        self.own, self.range_hash = None, None

    def _end_files(self) -> None:
        if not self.xorb_at:
            self._end_own()
            self.out += c.BOOKEND
            self.xorb_at = len(self.out)

    def _grown(self, at: int, *sums: int) -> None:
        """Add to the counts of the header at ``at``."""
        view = memoryview(self.out)[at + 36 : at + 36 + 4 * len(sums)].cast("I")
        for k, n in enumerate(sums):
            view[k] = _u32(view[k] + n)
        view.release()

    def _add(self, own: np.ndarray, rows: np.ndarray, heads: np.ndarray, ranges: list[bytes | None]) -> None:
        """Rows under their headers; ``heads`` and ``ranges`` have one a row."""
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]).any(axis=1)
        new[0] = self.own != own[0].tobytes()
        starts = [*([] if new[0] else [0]), *np.flatnonzero(new).tolist()]
        for s, e in zip(starts, [*starts[1:], len(own)], strict=True):
            if new[s]:
                self._end_own()
                self.own, self.own_at, self.range_hash = own[s].tobytes(), len(self.out), ranges[s]
                self.out += heads[s].tobytes()
            self.out += rows[s:e].tobytes()
            sums = [e - s] if not self.xorb_at else [e - s, int(rows["w"][s:e, 1].sum(dtype=np.int64))]
            self._grown(self.own_at, *sums)

    def add_segments(self, file_hash: np.ndarray, xorb_hash: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray, range_hash: list[bytes | None]) -> None:
        rows, heads = np.zeros(len(size), _ENTRY), np.zeros(len(size), _ENTRY)
        rows["hash"], heads["hash"] = xorb_hash, file_hash
        for k, x in enumerate((size, start, end)):
            rows["w"][:, 1 + k] = _all_u32(x)
        heads["w"][:, 0] = [0 if r is None else c.HAS_VERIFICATION for r in range_hash]
        self._add(file_hash, rows, heads, range_hash)

    def add_chunks(self, xorb_hash: np.ndarray, chunk_hash: np.ndarray, start: np.ndarray, size: np.ndarray, stored: np.ndarray) -> None:
        self._end_files()
        rows, heads = np.zeros(len(size), _ENTRY), np.zeros(len(size), _ENTRY)
        rows["hash"], heads["hash"] = chunk_hash, xorb_hash
        rows["w"][:, 0], rows["w"][:, 1], heads["w"][:, 3] = _all_u32(start), _all_u32(size), _all_u32(stored)
        self._add(xorb_hash, rows, heads, [None] * len(size))

    def close(self) -> bytearray:
        self._end_files()
        self._end_own()
        self.out += c.BOOKEND
        self.out += _FOOTER.pack(c.FOOTER_VERSION, c.SHARD_HEADER, self.xorb_at, self.key, self.created, self.expires, len(self.out))
        return self.out


@dataclass
class ShardLayout:
    """A shard's footer, and its headers as rows of (offset, entries, has a
    range hash); entries are read from ``data`` as they are asked for."""

    data: memoryview
    footer: Shard
    files: np.ndarray
    xorbs: np.ndarray

    def _entries(self, heads: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(position, header, index under it, its header, the entry, the range
        hash's place) of up to ``most`` entries at once."""
        if not len(heads):
            return
        base = int(heads[0, 0])
        all_rows = np.frombuffer(self.data, _ENTRY, (len(self.data) - base) // c.SHARD_ENTRY, base)
        first = (heads[:, 0] - base) // c.SHARD_ENTRY
        upto = np.cumsum(heads[:, 1])
        for s in range(0, int(upto[-1]), most):
            at = np.arange(s, min(s + most, int(upto[-1])))
            own = np.searchsorted(upto, at, side="right")
            index = at - (upto[own] - heads[own, 1])
            tail = np.minimum(first[own] + 1 + heads[own, 1], len(all_rows) - 1)
            yield at, heads[own, 2].astype(bool), index, all_rows[first[own]], all_rows[first[own] + 1 + index], all_rows["hash"][tail]

    def segments(self, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
        """(file_hash, index, xorb_hash, size, start, end, has a range hash, it)."""
        for _, ranged, index, head, row, tail in self._entries(self.files, most):
            yield head["hash"], index, row["hash"], row["w"][:, 1], row["w"][:, 2], row["w"][:, 3], ranged, tail

    def chunks(self, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
        """(position, xorb_hash, index, chunk_hash, start, size, stored bytes)."""
        for at, _, index, head, row, _ in self._entries(self.xorbs, most):
            yield at, head["hash"], index, row["hash"], row["w"][:, 0], row["w"][:, 1], head["w"][:, 3]


def _all_u32(x: np.ndarray) -> np.ndarray:
    if len(x) and not (0 <= int(x.min()) and int(x.max()) < 1 << 32):
        raise FormatError("a size does not fit 32 bits")
    return x


def shard_layout(data: bytes | memoryview, strict: bool = True) -> ShardLayout:
    """Where a shard's entries are. ``strict`` also checks the tag and that sections end
    where they should; else sections that are cut short end quietly."""
    if len(data) < c.SHARD_HEADER or len(data) < c.SHARD_FOOTER:
        raise FormatError("TruncatedShard")
    tag, version, _ = _HEADER.unpack_from(data)
    if strict and tag != c.SHARD_TAG:
        raise FormatError("InvalidShardTag")
    if version != c.SHARD_VERSION:
        raise FormatError("UnsupportedShardVersion")
    fv, file_at, xorb_at, key, created, expires, footer_at = _FOOTER.unpack_from(data, len(data) - c.SHARD_FOOTER)
    if fv != c.FOOTER_VERSION:
        raise FormatError("UnsupportedFooterVersion")
    out = Shard([], [], key, created, expires, file_at, xorb_at, footer_at)
    files_end, xorbs_end = xorb_at, len(data) - c.SHARD_FOOTER
    if strict and not (c.SHARD_HEADER <= file_at <= xorb_at <= xorbs_end):
        raise FormatError("TruncatedShard")
    size = c.SHARD_ENTRY

    def room(at: int, entries: int, end: int) -> bool:
        if at + entries * size <= end:
            return True
        if strict:
            raise FormatError("TruncatedShard")
        return False

    files, xorbs = array("q"), array("q")
    at = file_at
    while at + size <= files_end and data[at : at + size] != c.BOOKEND:
        _, flags, n = _FILE.unpack_from(data, at)
        extra = bool(flags & c.HAS_VERIFICATION)
        if not room(at, 1 + n + extra, files_end):
            break
        files.extend((at, n, extra))
        at += size * (1 + n + extra)
    at = xorb_at
    while at + size <= xorbs_end and data[at : at + size] != c.BOOKEND:
        n = _XORB.unpack_from(data, at)[2]
        if not room(at, 1 + n, xorbs_end):
            break
        xorbs.extend((at, n, False))
        at += size * (1 + n)
    return ShardLayout(memoryview(data), out, *(np.frombuffer(x, np.int64).reshape(-1, 3) for x in (files, xorbs)))


def parse_shard(data: bytes, strict: bool = True) -> Shard:
    """A shard's contents, as objects (see :func:`shard_layout` for large ones)."""
    got = shard_layout(data, strict)
    out, size = got.footer, c.SHARD_ENTRY
    for at, n, extra in got.files.tolist():
        segments = []
        for i in range(n):
            h, _, length, a, b = _SEGMENT.unpack_from(data, at + size * (1 + i))
            segments.append((h, length, a, b))
        range_hash = _RANGE.unpack_from(data, at + size * (1 + n))[0] if extra else None
        out.files.append(FileInfo(_FILE.unpack_from(data, at)[0], segments, range_hash))
    for at, n, _ in got.xorbs.tolist():
        xorb_hash, _, _, raw, stored = _XORB.unpack_from(data, at)
        rows = np.frombuffer(data, _CHUNK, n, at + size)
        out.xorbs.append(XorbInfo(xorb_hash, [(r["hash"].tobytes(), int(r["start"]), int(r["size"])) for r in rows], raw, stored))
    return out
