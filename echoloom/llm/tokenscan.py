"""Vectorised scan of texts into word hashes, shared by operators that look at every word.

A token is a run of ASCII letters, digits and bytes above 127, with A-Z lower-cased; everything
else separates tokens. Hashes are 64-bit polynomials over the bytes of a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: texts are put together up to this many bytes for one vectorised step; a longer text is a step of its own
STEP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    inside, low = np.zeros(256, bool), np.arange(256, dtype=np.uint64) + 1
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        inside[lo:hi] = True
    low[65:91] += 32
    return inside, low


INSIDE, LOWER = _tables()


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS = powers(64)


class Scan:
    """Tokens of some texts: ``hash``, ``start``, ``stop`` (byte offsets in ``data``) and ``doc`` (index of the text)."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join([*texts, b""])
        b = np.frombuffer(self.data, np.uint8)
        inside = INSIDE[b]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.stop = edge[::2], edge[1::2]
        length = self.stop - self.start
        pos = np.flatnonzero(inside)
        if len(self.start):
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            within = np.arange(len(pos)) - np.repeat(first, length)
            longest = int(length.max())
            p = POWERS if longest <= len(POWERS) else powers(longest)
            h = np.add.reduceat(LOWER[b[pos]] * p[within], first)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            self.hash = h ^ (h >> np.uint64(32))
            self.bytes, self.pos, self.first = b, pos, first
        else:
            self.hash = np.zeros(0, np.uint64)
            self.bytes, self.pos, self.first = b, pos, np.zeros(0, np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(ends, self.start, side="right")


def steps(column) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first text, texts) of an Arrow string column, a bounded amount at a time; NULL is empty."""
    held, size, at = [], 0, 0
    for i, v in enumerate(column):
        t = (v.as_py() or "").encode()
        if held and size + len(t) > STEP_BYTES:
            yield at, held
            held, size, at = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield at, held
