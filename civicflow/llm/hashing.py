"""Vectorised 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_731)
#: For each of two independent hashes: a random odd value per byte and powers of an odd multiplier per position.
_BYTES = [_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_POWERS = [np.cumprod(np.full(4096, m, np.uint64)) for m in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words (runs without ASCII white space) of several texts, in order."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        #: where each text begins in ``raw``
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.codes = np.frombuffer(self.raw, np.uint8)
        inside = np.zeros(len(self.codes) + 2, np.int8)
        inside[1:-1] = _IS_WORD[self.codes]
        change = np.diff(inside)
        self.starts = np.flatnonzero(change == 1)
        self.ends = np.flatnonzero(change == -1)
        self._inside = inside[1:-1].view(bool)
        #: the first word of each text, and the number of all words at the end
        self.first = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))
        self.count = np.diff(self.first)
        #: the text of each word
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash per word; ``which`` selects one of two independent functions."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        position = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        values = _BYTES[which][self.codes[self._inside]]
        if int(lengths.max()) > 4096:
            values = values * _POWERS[which][position & 4095] * mix((position >> 12).astype(np.uint64) + np.uint64(1))
        else:
            values = values * _POWERS[which][position]
        return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64))

    def join(self, first: int, last: int) -> bytes:
        """Words first to last - 1 joined by one space."""
        return b" ".join(self.raw[self.starts[first]:self.ends[last - 1]].split()) if last > first else b""
