"""Hilbert curve positions of points on an integer grid, in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve (unsigned 64-bit) of integer points (point, axis) of `bits` bits each; bits x axes <= 63.

    The grid coordinates are turned in place into the curve's transposed index (Skilling's transform:
    undo excess work from the top bit down, then Gray-code), whose bits are then interleaved.
    """
    x = grid.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << np.uint64(1) | ((x[i] >> bit) & 1).astype(np.uint64)
    return key
