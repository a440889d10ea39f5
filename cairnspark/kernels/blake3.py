"""Keyed BLAKE3 of many messages at once, with one lane a 1024-byte block run.

All full and partial 1 KiB chunks of a batch are compressed together, sixteen
block steps whatever their number; then parents are merged level by level, again
all messages together. Written from the published specification.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_FIRST, _LAST, _PARENT, _ROOT, _KEYED = 1, 2, 4, 8, 16
_CHUNK = 1024
#: Lanes compressed together; keeps the state in the cache.
_LANES = 4096


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _rounds(v: np.ndarray, m: np.ndarray) -> None:
    """Seven rounds on states v [16, lanes] with message words m [16, lanes].

    Rows of four columns are mixed at once; the diagonals by rolling rows.
    """
    a, b, c, d = v[0:4], v[4:8], v[8:12], v[12:16]
    order = list(range(16))

    def quarter(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal a, b, c, d
        a = a + b + x
        d = _rotate(d ^ a, 16)
        c = c + d
        b = _rotate(b ^ c, 12)
        a = a + b + y
        d = _rotate(d ^ a, 8)
        c = c + d
        b = _rotate(b ^ c, 7)

    for r in range(7):
        w = m[order]
        quarter(w[0:8:2], w[1:8:2])
        b, c, d = np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0)
        quarter(w[8:16:2], w[9:16:2])
        b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
        if r < 6:
            order = [order[i] for i in _ORDER]
    v[0:4], v[4:8], v[8:12], v[12:16] = a, b, c, d


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values [8, lanes] after one block [16, lanes]."""
    v = np.empty((16, cv.shape[1]), np.uint32)
    v[0:8] = cv
    v[8:12] = _IV[:4, None]
    v[12] = counter & 0xFFFFFFFF
    v[13] = counter >> 32
    v[14] = size
    v[15] = flags
    _rounds(v, block)
    return v[0:8] ^ v[8:16]


def _chunk_values(words: np.ndarray, lengths: np.ndarray, counters: np.ndarray, root: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Chaining values [8, lanes] of chunks: words [lanes, 256], their bytes."""
    out = np.empty((8, len(lengths)), np.uint32)
    for s in range(0, len(lengths), _LANES):
        part = slice(s, s + _LANES)
        w, n = words[part].reshape(-1, 16, 16).transpose(1, 2, 0), lengths[part]
        blocks = np.maximum(1, -(-n // 64))
        cv = np.repeat(key[:, None], len(n), axis=1)
        for b in range(int(blocks.max(initial=1))):
            live = np.flatnonzero(blocks > b)
            last = blocks[live] == b + 1
            flags = np.full(len(live), _KEYED | (_FIRST if b == 0 else 0), np.uint32)
            flags |= np.where(last, np.uint32(_LAST), np.uint32(0))
            flags |= np.where(last & root[part][live], np.uint32(_ROOT), np.uint32(0))
            size = np.minimum(64, n[live] - 64 * b).astype(np.uint32)
            cv[:, live] = _compress(cv[:, live], w[b][:, live], counters[part][live], size, flags)
        out[:, part] = cv
    return out


def keyed(key: bytes, messages: Sequence[bytes]) -> list[bytes]:
    """The 32-byte keyed digest of each message."""
    if len(key) != 32:
        raise ValueError("a key has 32 bytes")
    if not messages:
        return []
    key_words = np.frombuffer(key, "<u4").astype(np.uint32)
    sizes = np.array([len(m) for m in messages], np.int64)
    chunks = np.maximum(1, -(-sizes // _CHUNK))
    first = np.cumsum(chunks) - chunks
    padded = np.zeros(int(chunks.sum()) * _CHUNK, np.uint8)
    for m, at in zip(messages, (first * _CHUNK).tolist(), strict=True):
        padded[at : at + len(m)] = np.frombuffer(m, np.uint8)
    owner = np.repeat(np.arange(len(messages)), chunks)
    counters = (np.arange(len(owner)) - first[owner]).astype(np.uint64)
    lengths = np.minimum(_CHUNK, sizes[owner] - counters.astype(np.int64) * _CHUNK)
    values = _chunk_values(padded.view("<u4").astype(np.uint32, copy=False).reshape(-1, 256), lengths, counters, chunks[owner] == 1, key_words)
    # Pair neighbours level by level; an odd last node moves up as it is. That
    # is the tree whose left subtrees are the largest powers of two.
    count = chunks.copy()
    while count.max() > 1:
        start = np.cumsum(count) - count
        pairs = count // 2
        up = (count + 1) // 2
        up_start = np.cumsum(up) - up
        nxt = np.empty((8, int(up.sum())), np.uint32)
        o = np.repeat(np.arange(len(count)), pairs)
        j = np.arange(len(o)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left = start[o] + 2 * j
        merged = np.empty((8, len(o)), np.uint32)
        for s in range(0, len(o), _LANES):
            l, own = left[s : s + _LANES], o[s : s + _LANES]
            flags = np.full(len(l), _KEYED | _PARENT, np.uint32) | np.where(count[own] == 2, np.uint32(_ROOT), np.uint32(0))
            block = np.concatenate([values[:, l], values[:, l + 1]])
            cv = np.repeat(key_words[:, None], len(l), axis=1)
            merged[:, s : s + _LANES] = _compress(cv, block, np.zeros(len(l), np.uint64), np.full(len(l), 64, np.uint32), flags)
        nxt[:, up_start[o] + j] = merged
        odd = np.flatnonzero(count % 2)
        nxt[:, up_start[odd] + up[odd] - 1] = values[:, start[odd] + count[odd] - 1]
        values, count = nxt, up
    raw = np.ascontiguousarray(values.T).astype("<u4").tobytes()
    return [raw[32 * i : 32 * i + 32] for i in range(len(messages))]
