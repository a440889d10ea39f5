"""The aggregation tree over (hash, size) nodes.

A level is cut into groups of three to nine nodes: after the first node from
the third on whose hash ends the group (its last eight bytes, little-endian,
are a multiple of four), or after nine. Groups of two or fewer only come last.
A group's hash covers a text line of each of its nodes.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from ..constants import NODE_KEY, ZERO
from .blake3 import keyed

Node = tuple[bytes, int]


def api_hex(h: bytes) -> str:
    """A hash as text: each of its four 64-bit words, byte-reversed, in hex."""
    return b"".join(h[i : i + 8][::-1] for i in range(0, 32, 8)).hex()


def from_api_hex(text: str) -> bytes:
    if len(text) != 64:
        raise ValueError("InvalidHexLength")
    raw = bytes.fromhex(text)
    return b"".join(raw[i : i + 8][::-1] for i in range(0, 32, 8))


def ends_group(h: bytes, size: int) -> bool:
    """Whether a node, the ``size``-th of its group, ends it."""
    return size == 9 or (size >= 3 and h[24] & 3 == 0)


def cuts(hashes: Sequence[bytes]) -> list[int]:
    """Ends of the groups of one level."""
    out, start, n = [], 0, len(hashes)
    for i, h in enumerate(hashes):
        size = i - start + 1
        if ends_group(h, size) or i == n - 1:
            out.append(i + 1)
            start = i + 1
    return out


def fold(levels: list[list[Node]]) -> list[list[Node]]:
    """One level up for many trees at once, hashing all groups together."""
    texts, sizes, shape = [], [], []
    for nodes in levels:
        start, groups = 0, 0
        for end in cuts([h for h, _ in nodes]):
            group = nodes[start:end]
            texts.append("".join(f"{api_hex(h)} : {s}\n" for h, s in group).encode())
            sizes.append(sum(s for _, s in group))
            start, groups = end, groups + 1
        shape.append(groups)
    merged = iter(zip(keyed(NODE_KEY, texts), sizes, strict=True))
    return [[next(merged) for _ in range(n)] for n in shape]


def roots(trees: Iterable[Sequence[Node]]) -> list[bytes]:
    """The root hash of each tree: zero for none, the leaf itself for one."""
    work = [list(t) for t in trees]
    while True:
        todo = [i for i, nodes in enumerate(work) if len(nodes) > 1]
        if not todo:
            return [nodes[0][0] if nodes else ZERO for nodes in work]
        for i, level in zip(todo, fold([work[i] for i in todo]), strict=True):
            work[i] = level


def file_hashes(trees: Iterable[Sequence[Node]], salt: bytes = ZERO) -> list[bytes]:
    """Hashes of files from their chunks; zero for an empty file."""
    trees = list(trees)
    out = keyed(salt, roots(trees))
    return [h if t else ZERO for h, t in zip(out, trees, strict=True)]


class OpenTree:
    """A root folded while its leaves arrive, in order, a run at a time.

    Of each level it keeps the nodes after the last group's end, nine at most.
    """

    def __init__(self) -> None:
        self.rest: list[list[Node]] = []
        self.seen: list[int] = []
        self.size = self.count = 0

    def push(self, nodes: Sequence[Node], level: int = 0) -> None:
        if level == len(self.rest):
            self.rest.append([])
            self.seen.append(0)
        if level == 0:
            self.size += sum(n for _, n in nodes)
            self.count += len(nodes)
        self.seen[level] += len(nodes)
        held = [*self.rest[level], *nodes]
        ends = cuts([h for h, _ in held])
        # the last group may still grow, and a lone node may be the root
        if ends and not ends_group(held[-1][0], ends[-1] - (ends[-2] if len(ends) > 1 else 0)):
            ends.pop()
        done = held[: ends[-1]] if ends else []
        self.rest[level] = held[len(done) :]
        if done:
            self.push(fold([done])[0], level + 1)

    def close(self) -> bytes:
        level = 0
        while level < len(self.rest):
            rest = self.rest[level]
            if self.seen[level] == 1 and len(rest) == 1:
                return rest[0][0]
            if rest:
                self.rest[level] = []
                self.push(fold([rest])[0], level + 1)
            level += 1
        return ZERO
