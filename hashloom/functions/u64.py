"""Unsigned 64-bit arithmetic on Columns.

Spark has no unsigned types and, in ANSI mode, BIGINT products must not overflow.  A 64-bit
value is a BIGINT of the same bits; full products are made in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

M16, M32, M64 = 0xFFFF, 0xFFFFFFFF, (1 << 64) - 1
P61 = (1 << 61) - 1


def signed(v: int) -> int:
    """The BIGINT that has the bits of an unsigned 64-bit integer."""
    v &= M64
    return v - (1 << 64) if v >> 63 else v


def bits(v: int) -> Column:
    return F.lit(signed(v)).cast("long")


def limbs_of(v: int) -> list[int]:
    return [(v >> s) & M16 for s in (0, 16, 32, 48)]


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(M32).cast("long"))


def splitmix64_py(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def in_batches(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A function of uint64 arrays as one of BIGINT columns; null stays null.  As a Column
    it is one node, so filters and joins on it copy no arithmetic."""

    @F.arrow_udf(T.LongType())
    def run(x: pa.Array) -> pa.Array:
        null = x.is_null().to_numpy(zero_copy_only=False)
        out = f(x.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.array(out.view(np.int64), pa.int64(), mask=null if null.any() else None)

    return lambda x: run(x.cast("long"))


def _splitmix64(h: np.ndarray) -> np.ndarray:
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def splitmix64(x: Column) -> Column:
    """splitmix64 of a BIGINT taken as unsigned.  Its two 64-bit products would be some
    hundred limb operations as Columns, so it is an Arrow batch function."""
    return in_batches(_splitmix64)(x)


def mul64(a, b):
    """128-bit product of uint64 arrays: (low, high)."""
    s, m = np.uint64(32), np.uint64(M32)
    a0, a1, b0, b1 = a & m, a >> s, b & m, b >> s
    p00, p01, p10 = a0 * b0, a0 * b1, a1 * b0
    mid = (p00 >> s) + (p01 & m) + (p10 & m)
    return a * b, a1 * b1 + (p01 >> s) + (p10 >> s) + (mid >> s)


def _mod61(x: np.ndarray) -> np.ndarray:
    """Of any 64-bit value; 2^61 is 1, so the upper bits are added to the lower."""
    p, s = np.uint64(P61), np.uint64(61)
    x = (x & p) + (x >> s)
    return np.where(x >= p, x - p, x)


def poly61(x: np.ndarray, coeffs: list[int]) -> np.ndarray:
    """A polynomial mod 2^61 - 1, the highest coefficient first, by Horner's rule."""
    x = _mod61(x)
    h, s = np.zeros(len(x), np.uint64), np.uint64(61)
    for c in coeffs:
        low, high = mul64(h, x)
        h = _mod61((low & np.uint64(P61)) + ((low >> s) | (high << np.uint64(3))) + np.uint64(c))
    return h


def fast_range32(h: Column, n: int) -> Column:
    """floor(h * n / 2^32) for 32-bit h; n below 2^31 keeps the product in range."""
    if not 0 < n < 1 << 31:
        raise ValueError("the range must be in 1 .. 2^31 - 1")
    return F.shiftright(h * F.lit(n).cast("long"), 32)
