"""Positions along a Hilbert curve in any number of dimensions, for whole batches of points."""

from __future__ import annotations

import numpy as np


def positions(cells: np.ndarray, bits: int) -> list[bytes]:
    """Big-endian position of each row of ``cells`` (whole numbers of ``bits`` bits) along the curve.

    Bytes compare as positions do. The cells are turned into the curve's own coordinates bit by bit from the top:
    where a coordinate's bit is set, the lower bits of the first coordinate are mirrored, else they are exchanged with
    those of that coordinate; a Gray code over the coordinates then gives the digits.
    """
    n, d = cells.shape
    if n == 0 or d == 0:
        return [b""] * n
    x = np.array(cells.T, dtype=np.uint32)
    for level in range(bits - 1, 0, -1):
        top, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(d):
            here = (x[i] & top) != 0
            swap = np.where(here, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(here, low, swap)
            x[i] ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    # digits: the top bit of every coordinate, then the next one of every coordinate, ...
    digits = np.stack([(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)])
    packed = np.packbits(digits.reshape(bits * d, n).T.astype(np.uint8), axis=1)
    return [r.tobytes() for r in packed]
