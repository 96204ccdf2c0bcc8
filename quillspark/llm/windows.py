"""Winnowed anchors and rolling hashes over runs of words or bytes, for the substring operators.

Two equal windows have the same smallest gram at the same offset, their anchor. So equal windows
are only ever found among windows whose anchors have equal hashes, and only anchors (a few
hundredths of all positions) need to be compared across a corpus.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = 24


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << max(20, n.bit_length())
            for name, factor in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, factor, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


def _scatter(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


#: A hash for each byte value.
BYTE_HASHES = _scatter(_scatter(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)))


class Rolling:
    """Hashes of any run of items in constant time each."""

    def __init__(self, items: np.ndarray) -> None:
        up, self.down = _powers.get(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, U64)
        np.cumsum(items * up[: len(items)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        """Of the n items from each place that has as many."""
        if len(self.sums) <= n:
            return np.empty(0, U64)
        return _scatter((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        return _scatter((self.sums[starts + n] - self.sums[starts]) * self.down[starts])


def _smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the (leftmost) smallest of each width consecutive grams."""
    out, step = [], (1 << PLACES) - width
    for a in range(0, max(1, len(grams) - width + 1), step):
        part = grams[a : a + step + width - 1]
        if len(part) < width:
            break
        low = U64((1 << PLACES) - 1)
        packed = (part & ~low) | np.arange(len(part), dtype=U64)
        span = 1
        while 2 * span <= width:
            packed = np.minimum(packed[:-span], packed[span:])
            span *= 2
        if span < width:
            packed = np.minimum(packed[: len(packed) - (width - span)], packed[width - span :])
        out.append((packed & low).astype(np.int64) + a)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def anchors(grams: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, first window, last window) of each anchor of documents laid end to end.

    starts has where each document begins, and the end; grams the hash of the gram items from each place.
    """
    nothing = np.empty(0, np.int64)
    place = _smallest(grams, window - gram + 1)
    if not len(place):
        return nothing, nothing, nothing, nothing
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(place)]
    valid = np.flatnonzero(np.arange(len(place)) + window <= starts[doc + 1])
    if not len(valid):
        return nothing, nothing, nothing, nothing
    place = place[valid]
    new = np.flatnonzero(np.diff(place)) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(place) - 1]))
    return doc[valid[first]], place[first], valid[first], valid[last]


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..last, and which range each belongs to."""
    sizes = last - first + 1
    which = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return first[which] + inside, which


def covered(starts: np.ndarray, window: int, length: int) -> np.ndarray:
    """Which of length items lie in a window that begins at one of the starts."""
    change = np.zeros(length + 1, np.int64)
    starts = starts[starts < length]
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, length), -1)
    return np.cumsum(change[:-1]) > 0
