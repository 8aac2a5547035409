"""Vectorised hashes of byte spans: polynomial prefix sums modulo 2**64, two bases."""

from __future__ import annotations

import numpy as np

# Fixed odd bases; any odd number has an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        step = step * step % (1 << 64)
        done += more
    return out


class SpanHasher:
    """Hashes of any spans of a text after one linear pass over it."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, base: int = BASES[0]):
        self.base = base

    def _table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = self._tables.get(self.base)
        if got is None or len(got[0]) < n:
            size = max(1 << 17, 1 << (n - 1).bit_length())
            got = (_powers(self.base, size), _powers(pow(self.base, -1, 1 << 64), size))
            self._tables[self.base] = got
        return got

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of (byte + 1) * base**i, with a leading 0."""
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        term = data.astype(np.uint64)
        term += np.uint64(1)
        term *= self._table(len(data) + 1)[0][: len(data)]
        np.cumsum(term, out=out[1:])
        return out

    def rolling(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of each ``k`` symbols, ascending by start; its high bits are well spread, its low ones are not."""
        n = max(len(prefix) - k, 0)
        out = prefix[k:] - prefix[:n]
        out *= self._table(len(prefix))[1][:n]
        out *= np.uint64(BASES[1])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hashes of the bytes [start, end)."""
        return mix((prefix[end] - prefix[start]) * self._table(len(prefix))[1][start])
