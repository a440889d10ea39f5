"""Content-defined chunk boundaries.

The gear hash of position i depends on the last 64 bytes alone (older terms are
shifted out of 64 bits), so all hashes come from six doubling passes over the
bytes; only the choice among the sparse candidates is sequential. Boundaries
therefore do not depend on how the bytes were read.

The byte table is a parameter of 256 words. The default is made by a rule; for
boundaries equal to other tools', pass the table those tools use (see
:func:`table_of`).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np

from ..constants import CUT_BITS, MAX_CHUNK, MIN_CHUNK, NORMAL_CHUNK

_PIECE = 1 << 20

#: The default table: of each byte, the first eight bytes of its SHA-256.
RULE_TABLE = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "big") for b in range(256)], np.uint64)


def table_of(words: str | Sequence[int] | None) -> np.ndarray:
    """A byte table: 256 numbers, or their hexadecimal text (blank-separated);
    None is the rule's."""
    if words is None:
        return RULE_TABLE
    numbers = [int(x, 16) for x in words.split()] if isinstance(words, str) else list(words)
    if len(numbers) != 256:
        raise ValueError("a gear table has 256 words")
    return np.array(numbers, np.uint64)


def gear_hashes(data: np.ndarray, table: np.ndarray = RULE_TABLE) -> np.ndarray:
    """The rolling hash after each byte of a fresh, never reset, window."""
    h = table[data]
    for m in (1, 2, 4, 8, 16, 32):
        if len(h) <= m:
            break
        h[m:] = h[m:] + (h[:-m] << np.uint64(m))
    return h


def gear_candidates(data: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Ends (exclusive) at which the hash says cut, ascending."""
    out = []
    for s in range(0, len(data), _PIECE):
        lead = min(s, 63)
        h = gear_hashes(data[s - lead : s + _PIECE], table)[lead:]
        out.append(np.flatnonzero(h >> np.uint64(64 - bits) == 0) + s + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def gear_cuts(data: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, bits: int = CUT_BITS, table: np.ndarray = RULE_TABLE) -> list[int]:
    """Chunk ends of some bytes; the last is their length. Empty for none.

    ``least`` has to be 64 or more, as a shorter chunk would show where the
    window was reset.
    """
    if least < 64 or most < least:
        raise ValueError("chunks are of 64 bytes at least, and least <= most")
    n = len(data)
    if n <= least:
        return [n] if n else []
    found = gear_candidates(np.frombuffer(data, np.uint8), table, bits).tolist()
    cuts, start = [], 0
    while n - start > least:
        k = bisect_left(found, start + least)
        end = min(found[k] if k < len(found) else n, start + most)
        if end >= n:
            break
        cuts.append(end)
        start = end
    return [*cuts, n]


class cuts_of_candidates:
    """:func:`gear_cuts` as a fold over a file's candidates, which come in
    order: chunks (index, start, end) as far as they are decided."""

    def __init__(self, n: int, least: int, most: int):
        if least < 64 or most < least:
            raise ValueError("chunks are of 64 bytes at least, and least <= most")
        self.n, self.least, self.most, self.start, self.index = n, least, most, 0, 0

    def _cut(self, end: int) -> tuple[int, int, int]:
        out = (self.index, self.start, end)
        self.start, self.index = end, self.index + 1
        return out

    def add(self, found: Sequence[int]) -> list[tuple[int, int, int]]:
        out = []
        for at in found:
            while at - self.start > self.most and self.start + self.most < self.n:
                out.append(self._cut(self.start + self.most))
            if at - self.start >= self.least and at < self.n:
                out.append(self._cut(at))
        return out

    def end(self) -> list[tuple[int, int, int]]:
        out = []
        while self.start + self.most < self.n:
            out.append(self._cut(self.start + self.most))
        return [*out, self._cut(self.n)]


# -- UltraCDC, from the published description ------------------------------

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_PATTERN = np.uint8(0xAA)
#: Distance masks before and after the normal size, and the low-entropy limit.
_MASK_SMALL, _MASK_LARGE, _LOW_ENTROPY = 0x2F, 0x2C, 64


def ultra_end(data: np.ndarray, least: int, normal: int, most: int) -> int:
    n = len(data)
    if n <= least:
        return n
    most = min(n, most)
    distance = _POP[data ^ _PATTERN].astype(np.int64)
    # distance of the eight bytes before each position to the pattern
    total = np.concatenate([[0], np.cumsum(distance[:most])])
    repeats, at = 0, least
    window = data[at - 8 : at].tobytes()
    while at + 8 <= most:
        following = data[at : at + 8].tobytes()
        if following == window:
            repeats += 1
            if repeats == _LOW_ENTROPY:
                return at + 8
            at += 8
            continue
        repeats = 0
        mask = _MASK_SMALL if at < normal else _MASK_LARGE
        d = total[at : at + 8] - total[at - 8 : at]
        hit = np.flatnonzero(d & mask == 0)
        if len(hit):
            return at + int(hit[0])
        window, at = following, at + 8
    return most


def ultra_cuts(data: bytes, least: int = MIN_CHUNK, normal: int = NORMAL_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Chunk ends by UltraCDC; chunks tile the bytes, the tail included."""
    arr, cuts, start = np.frombuffer(data, np.uint8), [], 0
    while start < len(arr):
        start += ultra_end(arr[start : start + most], least, normal, most)
        cuts.append(start)
    return cuts


ALGORITHMS = {"gearhash": gear_cuts, "ultracdc": ultra_cuts}


def cut(data: bytes, algorithm: str = "gearhash", least: int = MIN_CHUNK, most: int = MAX_CHUNK, bits: int = CUT_BITS, table: np.ndarray = RULE_TABLE) -> list[int]:
    """Chunk ends of some bytes by either algorithm."""
    if algorithm == "ultracdc":
        return ultra_cuts(data, least, min(max(NORMAL_CHUNK * least // MIN_CHUNK, least), most), most)
    if algorithm != "gearhash":
        raise ValueError(f"algorithm is one of {sorted(ALGORITHMS)}")
    return gear_cuts(data, least, most, bits, table)
