"""Words, shingles and their hashes for many texts at once, in numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that one block of texts has at most; a longer text is a block by itself.
BLOCK = 1 << 20

_M1, _M2, _PRIME = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x100000001B3
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers = _inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


def _grown(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        inverse = pow(_PRIME, -1, 1 << 64)
        size = max(n, BLOCK + 64)
        for name, base in (("_powers", _PRIME), ("_inverses", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of at most so many bytes together, with the place of the first."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


class Words:
    """The words ([^\\x20\\x09-\\x0D]+) of a list of texts: start and end in data, doc (place of the text), hash.

    first[i] is the place of the first word of text i, first[-1] the number of words.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join([*texts, b""])
        self.data = data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        space = _SPACE[data]
        edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        _grown(len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _inverses[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every n consecutive words of a text, with the place of the text. A text of fewer words has one of all its words."""
        h, first = self.hash, self.first
        counts = np.diff(first)
        total = len(h)
        full = np.zeros(0, np.uint64)
        where = np.zeros(0, np.int64)
        if total >= n:
            full = np.zeros(total - n + 1, np.uint64)
            for i in range(n):
                full = full * np.uint64(0x9E3779B97F4A7C15) + h[i : total - n + 1 + i]
            same = self.doc[: total - n + 1] == self.doc[n - 1 :]
            full, where = mix(full[same]), self.doc[: total - n + 1][same]
        few = np.flatnonzero((counts > 0) & (counts < n))
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for j, d in enumerate(few.tolist()):
                x = counts[d]
                value = int(x)
                for w in h[first[d] : first[d + 1]].tolist():
                    value = (value * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
                short[j] = value
            full, where = np.concatenate([full, mix(short ^ np.uint64(0x5BD1E995))]), np.concatenate([where, few])
            order = np.argsort(where, kind="stable")
            full, where = full[order], where[order]
        return full, where
