"""A counter-based generator that Spark, NumPy and plain SQL evaluate alike.

Every draw is a pure function of integer counters, so a lost task recomputes
the same numbers. All products stay below 2**63.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647
# Multipliers of the Lehmer family modulo 2**31 - 1.
A1, A2, A3 = 48271, 69621, 16807


def mix(a: Column, b: Column, seed: int) -> Column:
    """Integer in [0, M) from two non-negative counters."""
    x = (F.pmod(a, F.lit(M)) * A1 + F.pmod(b, F.lit(M)) * A2 + F.lit(seed * 40692 + 7)) % M
    x = (x * x + b % M) % M
    x = (x * A3 + a % M) % M
    x = (x * x + F.lit(seed + 12345)) % M
    return (x * A1 + 11) % M


def uniform(a: Column, b: Column, seed: int) -> Column:
    return mix(a.cast("bigint"), b.cast("bigint"), seed) / F.lit(float(M))


def _fold(x):
    """Congruent modulo M and below 2**32, for non-negative x."""
    return (x & M) + (x >> 31)


def _folded(x):
    """Congruent modulo M and at most 2**31, for non-negative x."""
    return _fold(_fold(x))


def mix_np(a, b, seed: int):
    """``mix``; remainders between steps are taken by folding, as M is 2**31 - 1."""
    a, b = a % M, b % M
    x = _folded(a * A1 + b * A2 + (seed * 40692 + 7))
    x = _folded(x * x + b)
    x = _folded(x * A3 + a)
    x = _folded(x * x + (seed + 12345))
    x = _folded(x * A1 + 11)
    return x - M * (x >= M)


def mix_grid(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """``mix`` of every ``a`` with every ``b``. In unsigned words one fold a step
    is enough to keep the next product below 2**64, and all steps are in place."""
    a, b = (a % M).astype(np.uint64)[:, None], (b % M).astype(np.uint64)[None, :]
    mask, bits = np.uint64(M), np.uint64(31)
    x = (a * np.uint64(A1) % mask) + (b * np.uint64(A2) + np.uint64(seed * 40692 + 7)) % mask
    high = np.empty_like(x)

    def fold():
        np.right_shift(x, bits, out=high)
        np.bitwise_and(x, mask, out=x)
        np.add(x, high, out=x)

    for left, right in ((None, b), (np.uint64(A3), a), (None, np.uint64(seed + 12345)), (np.uint64(A1), np.uint64(11))):
        np.multiply(x, x if left is None else left, out=x)
        np.add(x, right, out=x)
        fold()
    # Below 2 M: one more than the remainder is folded, so that M itself becomes 0.
    np.add(x, np.uint64(1), out=x)
    fold()
    return np.subtract(x, np.uint64(1), out=x)


def mix_sql(a: str, b: str, seed: int) -> str:
    """The same draw as SQL text over two BIGINT expressions."""
    x = f"((({a}) % {M}) * {A1} + (({b}) % {M}) * {A2} + {seed * 40692 + 7}) % {M}"
    x = f"(({x}) * ({x}) + ({b}) % {M}) % {M}"
    x = f"(({x}) * {A3} + ({a}) % {M}) % {M}"
    x = f"(({x}) * ({x}) + {seed + 12345}) % {M}"
    return f"((({x}) * {A1} + 11) % {M})"


def coin_np(x, key: int):
    """A fair bit per counter for one key: the parity of
    ``(((x + key) * A1) ** 2 * A3 + key) mod M``. This is the innermost step of
    a shuffle, so the remainders are taken by folding, as M is 2**31 - 1."""
    y = _fold(_fold((x + key) * A1))
    y = _fold(_fold(y * y))
    y = _fold(_fold(y * A3 + key))
    return (y + ((y + 1) >> 31)) & 1


def coin_sql(x: str, key: str) -> str:
    y = f"((({x}) + {key}) * {A1} % {M})"
    return f"((({y}) * ({y}) % {M} * {A3} + {key}) % {M} % 2)"
