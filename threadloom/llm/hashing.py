"""Hashes of 64 bits over numpy arrays."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the word and window hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)
