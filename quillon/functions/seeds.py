"""One seed for a run, and one of its own for each use of chance.

Nothing here has a global state: every draw is a hash of a seed and the keys
of a row, so it is the same on any number of executors and after a retry.
"""

from __future__ import annotations

import hashlib

import numpy as np

SEED = 42
#: Odd multipliers of mix32.
MIX = (2146121005, 2221713035)


def seed_for(use: str, seed: int = SEED) -> int:
    """A seed below 2^31 for one use, such as "bootstrap" or "shuffle"."""
    return int.from_bytes(hashlib.md5(f"{seed}:{use}".encode()).digest()[:4], "big") >> 1


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit over all, by two multiplications and three shifts."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(MIX[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(MIX[1])
    x ^= x >> np.uint32(16)
    return x
