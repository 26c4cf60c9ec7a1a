"""Windows of a symbol sequence, grouped into runs that share one anchor.

A *window* is ``length`` consecutive symbols.  Its *anchor* is the leftmost of its
``gram``-symbol substrings with the smallest hash, so equal windows have equal anchors at
equal places.  Consecutive windows with the same anchor form a *run*: one row stands for
about ``(length - gram) / 2`` windows.  A window that occurs twice has its anchor hash in two
runs, so grouping runs by anchor hash loses no repeated window.

Hashes are polynomials modulo 2**64 over symbols drawn from a random table, in two lanes with
different bases; equality of both lanes stands for equality of the symbols.
"""

from __future__ import annotations

import numpy as np

#: Symbols handled at once: positions within a slice fit in the low bits of a packed hash.
POSITION_BITS = 20
SLICE = 1 << 18

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all others (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: One 64-bit symbol for each byte value.
BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        up, down = [], []
        for base in _BASES:
            for out, b in ((up, base), (down, pow(base, -1, 1 << 64))):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
        _POWERS[size] = up, down
    return _POWERS[size]


class Hasher:
    """Prefix hashes of one sequence; any substring's two hashes in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        up, self.down = _powers(self.n + 1)
        self.prefix = []
        for p in up:
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(symbols * p[: self.n], out=total[1:])
            self.prefix.append(total)

    def lane(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self.prefix[which]
        return mix((p[end] - p[start]) * self.down[which][start])

    def grams(self, gram: int) -> np.ndarray:
        """First-lane hash of the gram at every start."""
        p, n = self.prefix[0], self.n - gram + 1
        return mix((p[gram:] - p[:n]) * self.down[0][:n])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, span = len(values) - width + 1, 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span : width - span + n])


def runs(symbols: np.ndarray, length: int, gram: int):
    """Yield ``(base, hasher, first, last, anchor)`` for each slice of one sequence.

    ``first``/``last`` are the starts of a run's first and last window and ``anchor`` the start
    of its anchor, all relative to ``base``, where the hasher's part of the sequence begins.
    """
    windows, low = len(symbols) - length + 1, np.uint64((1 << POSITION_BITS) - 1)
    for base in range(0, max(windows, 0), SLICE):
        part = symbols[base : min(base + SLICE, windows) + length - 1]
        hasher = Hasher(part)
        grams = hasher.grams(gram)
        packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min(packed, length - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:], len(least)) - 1
        yield base, hasher, first, last, (least[first] & low).astype(np.int64)
