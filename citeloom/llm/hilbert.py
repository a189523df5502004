"""Hilbert curve keys of points on a grid, for whole arrays at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (n x d integers below 2**bits), as uint64; d * bits <= 63.

    Works from the highest bit down: at each level the quadrant's bits are read
    through the orientation that the levels above have left, then lower levels
    are reflected or exchanged with the first axis.
    """
    n, d = cells.shape
    if d * bits > 63:
        raise ValueError("dimensions * bits must fit 63 bits")
    x = [cells[:, i].astype(np.int64) for i in range(d)]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(d):
            swap = (x[0] ^ x[i]) & low
            has = (x[i] & q) != 0
            first = np.where(has, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(has, x[i], x[i] ^ swap)
            x[0] = first
        q >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(n, np.int64)
    q = top
    while q > 1:
        turn = np.where((x[d - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | (((x[i] ^ turn) >> b) & 1).astype(np.uint64)
    return key
