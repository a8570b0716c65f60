"""The gear rolling hash: shift left by one, add a random value of the next byte. A byte leaves after 32 steps."""

from __future__ import annotations

import numpy as np

GEAR = np.random.default_rng(4242).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash after each byte. The first 31 bytes of a row, whose window reaches back over its start, get all ones."""
    h = GEAR[data]
    step = 1
    while step < 32:  # sums of 2, 4, ... 32 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    starts, ends = offsets[:-1], offsets[1:]
    for i in range(31):
        at = starts + i
        h[at[at < ends]] = 0xFFFFFFFF
    return h
