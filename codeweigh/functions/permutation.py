"""A computed permutation of the positions 0 .. n-1, from a seed.

A row that knows its position knows its shuffled place at once: no sort, no
shuffle, the same on any partitioning, and invertible (which row stands at place p?).

The position is written as two digits, ``x = left * b + right`` with ``left`` in 0..a-1 and
``right`` in 0..b-1 (a and b near the root of n, a * b >= n).  A Feistel network
adds to each digit in turn a keyed function of the other, modulo its base; every
such step can be undone, so together they permute 0..a*b-1.  The fewer than
a + b places beyond n-1 are left by walking on: a result of n or more
is permuted again until it falls below n, which keeps the map one-to-one.
All arithmetic is on integers below 2^53, so any engine gives the same places.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
# A prime and two multipliers of linear congruential generators modulo it.
PRIME, FIRST, SECOND = 2147483647, 48271, 69621
#: Low digits of the generator that are dropped.
COARSE = 16
#: Largest number of positions: its digits stay below the generator's range.
MOST = (PRIME // COARSE // 2) ** 2


def bases(n: int) -> tuple[int, int]:
    """a and b with a * b >= n, as close as whole numbers allow."""
    if not 0 < n <= MOST:
        raise ValueError(f"positions: 1 to {MOST}, not {n}")
    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def keys(seed: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % PRIME for i in range(ROUNDS)]


def _keyed(digit, key: int, base: int):
    return (digit + key) * FIRST % PRIME * SECOND % PRIME // COARSE % base


def _once(x: np.ndarray, a: int, b: int, ks: list[int], back: bool) -> np.ndarray:
    left, right = x // b, x % b
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            right = (right + sign * _keyed(left, ks[i], b)) % b
        else:
            left = (left + sign * _keyed(right, ks[i], a)) % a
    return left * b + right


def places(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Shuffled places of positions ``x`` (or, ``back``, positions of places)."""
    if len(x) and not (0 <= x.min() and x.max() < n):
        raise ValueError(f"positions must be from 0 to {n - 1}")
    a, b = bases(n)
    ks, out = keys(seed), _once(x, a, b, keys(seed), back)
    while (beyond := np.flatnonzero(out >= n)).size:
        out[beyond] = _once(out[beyond], a, b, ks, back)
    return out


def _column(col, n: int, seed: int, back: bool) -> Column:
    bases(n)  # refuses what is too large before the job starts

    @F.arrow_udf(T.LongType())
    def place(x: pa.Array) -> pa.Array:
        full = x.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(x), np.int64)
        valid = x.is_valid().to_numpy(zero_copy_only=False)
        out[valid] = places(full, n, seed, back)
        return pa.array(out, mask=~valid)

    return place((F.col(col) if isinstance(col, str) else col).cast("long"))


def permuted(col, n: int, seed: int) -> Column:
    """Place of a position after the shuffle; null stays null, a position outside 0..n-1 is an error."""
    return _column(col, n, seed, False)


def position_of(col, n: int, seed: int) -> Column:
    """The position that stands at a place: the inverse of :func:`permuted`."""
    return _column(col, n, seed, True)
