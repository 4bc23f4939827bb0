"""Words and shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
STRETCH = 1 << 17
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _power(n: int) -> list[np.ndarray]:
    """Powers 0..n of BASE and of its inverse; those of a stretch are kept, longer ones are not."""
    make = lambda size: [np.cumprod(np.r_[np.uint64(1), np.full(size, b % 2**64, np.uint64)]) for b in (BASE, pow(BASE, -1, 2**64))]
    if n > 2 * STRETCH:
        return make(n)
    if not _powers:
        _powers[:] = make(2 * STRETCH)
    return _powers


class Words:
    """The words (runs of bytes other than white space) of `texts`; with `fold`, ASCII capitals are taken as small letters.

    hash[i] is word i's 64-bit hash, start[i] and end[i] its place in the joined texts; text k begins at byte edge[k] and has the words
    word_edge[k]..word_edge[k+1].
    """

    def __init__(self, texts: list[bytes], fold: bool = True):
        letters = LOWER if fold else np.arange(256, dtype=np.uint8)
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.edge = np.r_[0, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]
        solid = ~SPACE[data]
        turn = np.flatnonzero(np.diff(np.r_[False, solid, False].view(np.int8)))
        self.start, self.end = turn[::2], turn[1::2]
        self.hash = np.empty(len(self.start), np.uint64)
        cuts = np.searchsorted(self.start, np.arange(0, len(data) + STRETCH, STRETCH)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):  # words by the stretch of bytes they begin in
            if b > a:
                low, high = int(self.start[a]), int(self.end[b - 1])
                power, inverse = _power(high - low)
                total = np.r_[np.uint64(0), np.cumsum((letters[data[low:high]].astype(np.uint64) + np.uint64(1)) * power[: high - low])]
                self.hash[a:b] = mix((total[self.end[a:b] - low] - total[self.start[a:b] - low]) * inverse[self.start[a:b] - low])
        self.word_edge = np.searchsorted(self.start, self.edge)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first word of each, edges by text) of all runs of `width` words within a text."""
        n = len(self.hash) - width + 1
        counts = np.maximum(np.diff(self.word_edge) - width + 1, 0)
        edges = np.r_[0, np.cumsum(counts)]
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), edges
        h = self.hash[:n] * np.uint64(3)
        for k in range(1, width):
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB) + self.hash[k : k + n]
        first = np.repeat(self.word_edge[:-1], counts) + np.arange(edges[-1]) - np.repeat(edges[:-1], counts)
        return mix(h[first]), first, edges
