"""Vectorised word shingles: 64-bit hashes of every word window of whole texts."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII capitals hash like their small letters.
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_MIX = [np.uint64(x | 1) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Hashes all words of a text at once, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self):
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def words(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint64)
        if len(raw) + 1 > len(self.up):
            self._grow(2 * len(raw) + 2)
        gap = np.concatenate([[True], _SEPARATOR[raw], [True]])
        begin = np.flatnonzero(gap[:-1] & ~gap[1:])
        end = np.flatnonzero(~gap[:-1] & gap[1:])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.up[: len(raw)], dtype=np.uint64)])
        word = (sums[end] - sums[begin]) * self.down[begin]
        return mix(word + (end - begin).astype(np.uint64) * _MIX[1])

    def shingles(self, text: str | None, size: int = 5) -> np.ndarray:
        """Ascending distinct hashes of all windows of ``size`` words; of all words if there are fewer."""
        w = self.words(text)
        if not len(w):
            return w
        n = max(1, len(w) - size + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(size, len(w))):
            out = mix(out * np.uint64(_BASE) + w[i : i + n])
        return np.unique(out)
