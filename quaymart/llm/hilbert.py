"""Hilbert curve keys of points with any number of coordinates, for whole arrays at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every point on the Hilbert curve through a cube of ``2 ** bits`` cells a side.

    ``cells`` is (points, dimensions) of whole numbers; ``bits * dimensions`` may be 63 at most. The
    curve is followed from the coarsest bit down: where a coordinate has the bit, the lower bits of
    the first one are mirrored, else they change places with the first one's; a Gray code of what
    is left gives the key.
    """
    n, dims = cells.shape
    if bits * dims > 63:
        raise ValueError("a key has 63 bits")
    x = [cells[:, d].astype(np.int64) for d in range(dims)]
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for d in range(dims):
            has = (x[d] & bit) != 0
            swap = np.where(has, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    flips = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] & (1 << level)) != 0, np.int64((1 << level) - 1), np.int64(0))
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (((x[d] ^ flips) >> level) & 1)
    return key
