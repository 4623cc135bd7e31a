"""Every random value is a pure function of (seed, tag, index): splitmix64 of their mix, or,
for tables filled by polynomial, a polynomial over 2^61 - 1 whose coefficients are such."""

from __future__ import annotations

import numpy as np

from hashloom.functions.u64 import M32, M64, P61, poly61, splitmix64_py

#: Coefficients of a polynomial that fills tables.
DEGREE = 100


def draw(seed: int, tag: str, index: int = 0) -> int:
    """An unsigned 64-bit value; the tag keeps uses apart."""
    h = 0xCBF29CE484222325
    for c in tag.encode():
        h = ((h ^ c) * 0x100000001B3) & M64
    return splitmix64_py(splitmix64_py((seed & M64) ^ h) + index)


def polynomial(seed: int, tag: str, degree: int = DEGREE) -> list[int]:
    """Coefficients below 2^61 - 1, the highest first, of a polynomial that is one of a
    ``degree``-wise independent family (but for the bias of a 64-bit draw mod 2^61 - 1)."""
    if degree < 1:
        raise ValueError("degree must be at least 1")
    return [draw(seed, f"poly {tag}", i) % P61 for i in range(degree)]


def filled(seed: int, tag: str, n: int, fill: str) -> list[int]:
    """n 64-bit values: draws by counter, or by polynomial, value i being the low halves of
    the polynomial's values at 2 i (below) and 2 i + 1 (above)."""
    if fill == "counter":
        return [draw(seed, tag, i) for i in range(n)]
    if fill != "polynomial":
        raise ValueError("fill must be counter or polynomial")
    v = poly61(np.arange(2 * n, dtype=np.uint64), polynomial(seed, tag)) & np.uint64(M32)
    return (v[0::2] | v[1::2] << np.uint64(32)).tolist()


def simple_table(seed: int, fill: str = "counter") -> list[list[int]]:
    """Four tables of 256 32-bit values; filled table by table, byte by byte."""
    v = filled(seed, "simple", 4 * 256, fill)
    return [[x & M32 for x in v[256 * i : 256 * (i + 1)]] for i in range(4)]


def tornado_table(seed: int, depth: int, fill: str = "counter") -> list[list[int]]:
    """Three tables of input bytes and one for each derived byte, of 64-bit values."""
    v = filled(seed, "tornado", (3 + depth) * 256, fill)
    return [v[256 * r : 256 * (r + 1)] for r in range(3 + depth)]


def coefficients(seed: int, n: int = 8) -> list[int]:
    """Odd 64-bit coefficients."""
    return [draw(seed, "coefficient", i) | 1 for i in range(n)]
