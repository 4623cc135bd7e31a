"""Hash families as plans: each adds a column of 32-bit hashes (BIGINT) to a frame.

Families over 32-bit keys are built-in expressions, but for rapid hash, whose 128-bit
products Spark has no arithmetic for.  That one and byte strings go through Arrow batch
functions in numpy, which work on all strings of one length at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.functions import params
from hashloom.functions.u64 import M32, M64, in_batches, limbs_of, low32, mul64, poly61, signed

# The secrets and the default seed of rapidhash.
SECRET = (0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9, 0x4B33A62ED433D4A3)
RAPID_SEED = 0xBDD89AA982704029


def long(v: int) -> Column:
    return F.lit(v).cast("long")


# -- 32-bit keys ----------------------------------------------------------------------


def multiply_shift(x: Column, a: int, b: int) -> Column:
    """hi32((a | 1) x + b mod 2^64)."""
    low = None
    for p, q in zip(limbs_of(a | 1), limbs_of(b), strict=True):
        t = x * long(p) + long(q)
        if low is not None:
            t = t + F.shiftrightunsigned(low, 16)
        before, low = low, t
    return F.shiftleft(low.bitwiseAND(long(0xFFFF)), 16).bitwiseOR(before.bitwiseAND(long(0xFFFF)))


def row_hash(x: Column, a: int, b: int) -> Column:
    """a x + b mod 2^32, a odd."""
    a, b = (a | 1) & M32, b & M32
    high = F.shiftleft((x * long(a >> 16)).bitwiseAND(long(0xFFFF)), 16)
    return low32(x * long(a & 0xFFFF) + high + long(b))


def row_hash_batch(h: np.ndarray, a: int, b: int) -> np.ndarray:
    return (h * np.uint64((a | 1) & M32) + np.uint64(b & M32)) & np.uint64(M32)


def _looked_up(table: list[int], index: Column) -> Column:
    # Parsed as one constant: a literal for each entry would cost a call each.
    literal = F.expr(f"array({', '.join(f'{signed(v)}L' if signed(v) > -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for v in table)})")
    return F.element_at(literal, (index + 1).cast("int"))


def byte_of(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 8 * i).bitwiseAND(long(255))


def simple_tabulation(x: Column, table: list[list[int]]) -> Column:
    out = _looked_up(table[0], byte_of(x, 0))
    for i in (1, 2, 3):
        out = out.bitwiseXOR(_looked_up(table[i], byte_of(x, i)))
    return out


def tornado(df: DataFrame, key: str, out: str, table: list[list[int]]) -> DataFrame:
    """Tornado tabulation; one derived character for each table after the third.  What is
    used twice is a projection of its own, which Spark doesn't fold into the next one."""
    x = F.col(key)
    h = _looked_up(table[0], byte_of(x, 0))
    for i in (1, 2):
        h = h.bitwiseXOR(_looked_up(table[i], byte_of(x, i)))
    df = df.withColumn("__t0", h.bitwiseXOR(byte_of(x, 3)))
    for k, derived in enumerate(table[3:]):
        h = F.col(f"__t{k}")
        df = df.withColumn(f"__t{k + 1}", F.shiftrightunsigned(h, 8).bitwiseXOR(_looked_up(derived, h.bitwiseAND(long(255)))))
    last = len(table) - 3
    return df.withColumn(out, low32(F.col(f"__t{last}"))).drop(*(f"__t{k}" for k in range(last + 1)))


def mix_py(a: int, b: int) -> int:
    p = a * b
    return (p >> 64) ^ (p & M64)


def seeded(seed: int, length: int) -> int:
    """The seed after the length is mixed in."""
    return seed ^ mix_py(seed ^ SECRET[0], SECRET[1]) ^ length


def rapid_u32_batch(x: np.ndarray, seed: int) -> np.ndarray:
    """Rapid hash, upper 32 bits, of the key's four bytes: both reads give (x << 32) | x."""
    both = (x << np.uint64(32)) | x
    low, high = mul64(both ^ np.uint64(SECRET[1]), both ^ np.uint64(seeded(seed, 4)))
    return _mix(low ^ np.uint64(SECRET[0] ^ 4), high ^ np.uint64(SECRET[1])) >> np.uint64(32)


def rapid_u32(key: Column, seed: int = RAPID_SEED) -> Column:
    return in_batches(lambda x: rapid_u32_batch(x, seed))(key)


def polynomial(key: Column, coeffs: list[int]) -> Column:
    """A polynomial mod 2^61 - 1 of a 64-bit key taken as unsigned, the highest coefficient first."""
    return in_batches(lambda x: poly61(x, coeffs))(key)


def word_le(key: Column, i: int) -> Column:
    """The i-th little-endian 32-bit word of a BINARY column."""
    pair = [F.hex(F.substring(key, 4 * i + 1 + k, 1)) for k in (3, 2, 1, 0)]
    return F.conv(F.concat(*pair), 16, 10).cast("long")


# -- byte strings, in batches ---------------------------------------------


def _mix(a, b):
    low, high = mul64(a, b)
    return low ^ high


def _read(m: np.ndarray, at: int, size: int) -> np.ndarray:
    if size in (4, 8):  # one view in place of a pass for each byte
        return np.ascontiguousarray(m[:, at : at + size]).view(f"<u{size}")[:, 0].astype(np.uint64)
    out = np.zeros(len(m), np.uint64)
    for k in range(size):
        out |= m[:, at + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def rapid64_batch(m: np.ndarray, seed: int) -> np.ndarray:
    """Rapid hash of the rows of a byte matrix."""
    rows, n = m.shape
    s0, s1, s2 = map(np.uint64, SECRET)
    start = np.full(rows, seeded(seed, n), np.uint64)
    zero = np.zeros(rows, np.uint64)
    if n <= 16:
        if n >= 4:
            delta = (n & 24) >> (n >> 3)
            r = lambda at: _read(m, at, 4)
            a = (r(0) << np.uint64(32)) | r(n - 4)
            b = (r(delta) << np.uint64(32)) | r(n - 4 - delta)
        elif n:
            a = (_read(m, 0, 1) << np.uint64(56)) | (_read(m, n >> 1, 1) << np.uint64(32)) | _read(m, n - 1, 1)
            b = zero
        else:
            a = b = zero
    else:
        r = lambda at: _read(m, at, 8)
        at, left = 0, n
        if left > 48:
            one, two = start.copy(), start.copy()
            while left >= 48:
                start = _mix(r(at) ^ s0, r(at + 8) ^ start)
                one = _mix(r(at + 16) ^ s1, r(at + 24) ^ one)
                two = _mix(r(at + 32) ^ s2, r(at + 40) ^ two)
                at, left = at + 48, left - 48
            start = start ^ one ^ two
        if left > 16:
            start = _mix(r(at) ^ s2, r(at + 8) ^ start ^ s1)
            if left > 32:
                start = _mix(r(at + 16) ^ s2, r(at + 24) ^ start)
        a, b = r(at + left - 16), r(at + left - 8)
    low, high = mul64(a ^ s1, b ^ start)
    return _mix(low ^ s0 ^ np.uint64(n), high ^ s1)


def ms_vector_batch(m: np.ndarray, coeffs: list[int]) -> np.ndarray:
    """Vector multiply-shift of the rows of a byte matrix."""
    rows, n = m.shape
    h, words = np.zeros(rows, np.uint64), n // 4
    for i in range(words):
        h += _read(m, 4 * i, 4) * np.uint64(coeffs[i % len(coeffs)])
    tail, at = np.zeros(rows, np.uint64), 4 * words
    if n & 2:
        tail, at = _read(m, at, 2), at + 2
    if n & 1:
        tail = (tail << np.uint64(8)) | _read(m, at, 1)
    if n & 3:
        h += tail * np.uint64(coeffs[words % len(coeffs)])
    return h >> np.uint64(32)


def loaded(keys: pa.Array):
    """Integers as a uint64 array; byte strings as (their number, [(places, byte matrix)
    of each length])."""
    if pa.types.is_integer(keys.type):
        return keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    keys = keys.cast(pa.large_binary())
    ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    lengths, parts = np.diff(ends), []
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        parts.append((at, data[ends[at][:, None] + np.arange(n)]))
    return len(keys), parts


def over_rows(keys, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    out = np.zeros(keys[0], np.uint64)
    for at, m in keys[1]:
        out[at] = f(m)
    return out


def _by_length(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A function of the rows of a byte matrix as one of a BINARY column."""

    @F.arrow_udf(T.LongType())
    def run(keys: pa.Array) -> pa.Array:
        out = over_rows(loaded(keys), f)
        null = keys.is_null().to_numpy(zero_copy_only=False)
        return pa.array(out.view(np.int64), pa.int64(), mask=null if null.any() else None)

    return run


def ms_vector(key: Column, coeffs: list[int]) -> Column:
    return _by_length(lambda m: ms_vector_batch(m, coeffs))(key)


def rapid(key: Column, seed: int = RAPID_SEED) -> Column:
    """The 64-bit rapid hash, as a BIGINT of the same bits."""
    return _by_length(lambda m: rapid64_batch(m, seed))(key)


def rapid32(key: Column, seed: int = RAPID_SEED) -> Column:
    return F.shiftrightunsigned(rapid(key, seed), 32)


def fnv1a32(key: Column) -> Column:
    """FNV-1a over a BINARY column, by a fold."""
    parts = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("long"))
    step = lambda h, c: low32(h.bitwiseXOR(c) * long(403) + F.shiftleft(low32(h.bitwiseXOR(c)).bitwiseAND(long(255)), 24))
    return F.when(F.octet_length(key) == 0, long(2166136261)).otherwise(F.aggregate(parts, long(2166136261), step))


# -- registry -------------------------------------------------------------------------


@dataclass(frozen=True)
class Family:
    """A hash family: ``apply(df, key, out, seed)`` adds the hash of ``key`` under the
    parameters that ``seed`` determines; ``batch(keys, seed)`` is the same in numpy, of
    keys as :func:`loaded` gives them, for many seeds at once."""

    name: str
    apply: Callable[[DataFrame, str, str, int], DataFrame]
    batch: Callable[[object, int], np.ndarray] | None = None


@lru_cache(256)
def _tables(kind: str, seed: int, depth: int = 0, fill: str = "counter") -> np.ndarray:
    return np.array(params.simple_table(seed, fill) if kind == "simple" else params.tornado_table(seed, depth, fill), np.uint64)


def _byte(x: np.ndarray, i: int) -> np.ndarray:
    return ((x >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64)


def simple_batch(x: np.ndarray, seed: int, fill: str = "counter") -> np.ndarray:
    t = _tables("simple", seed, 0, fill)
    return t[0][_byte(x, 0)] ^ t[1][_byte(x, 1)] ^ t[2][_byte(x, 2)] ^ t[3][_byte(x, 3)]


def tornado_batch(x: np.ndarray, seed: int, depth: int, fill: str = "counter") -> np.ndarray:
    t = _tables("tornado", seed, depth, fill)
    h = t[0][_byte(x, 0)] ^ t[1][_byte(x, 1)] ^ t[2][_byte(x, 2)] ^ (x >> np.uint64(24))
    for derived in t[3:]:
        h = (h >> np.uint64(8)) ^ derived[_byte(h, 0)]
    return h & np.uint64(M32)


def multiply_shift_batch(x: np.ndarray, seed: int) -> np.ndarray:
    a, b = params.draw(seed, "ms", 0) | 1, params.draw(seed, "ms", 1)
    return (x * np.uint64(a) + np.uint64(b)) >> np.uint64(32)


def _simple(fill: str = "counter") -> Family:
    return Family("SimpleTab32", lambda df, key, out, seed: df.withColumn(out, simple_tabulation(F.col(key), params.simple_table(seed, fill))), lambda x, seed: simple_batch(x, seed, fill))


def _tornado(depth: int, fill: str = "counter") -> Family:
    return Family(f"TornadoTab32D{depth}", lambda df, key, out, seed: tornado(df, key, out, params.tornado_table(seed, depth, fill)), lambda x, seed: tornado_batch(x, seed, depth, fill))


def _on_vector(name: str, then: Family | None) -> Family:
    """Vector multiply-shift, then a family over its 32-bit result.  All families of one
    seed share the coefficients, so they collide together where these do."""

    def apply(df: DataFrame, key: str, out: str, seed: int) -> DataFrame:
        to = out if then is None else f"{out}__ms"
        df = df.withColumn(to, ms_vector(F.col(key), params.coefficients(seed)))
        return df if then is None else then.apply(df, to, out, seed).drop(to)

    def batch(keys, seed: int) -> np.ndarray:
        h = over_rows(keys, lambda m: ms_vector_batch(m, params.coefficients(seed)))
        return h if then is None else then.batch(h, seed)

    return Family(name, apply, batch)


def _named(families: list[Family]) -> dict[str, Family]:
    return {f.name: f for f in families}


U32 = _named(
    [
        Family("MultShift", lambda df, key, out, seed: df.withColumn(out, multiply_shift(F.col(key), params.draw(seed, "ms", 0), params.draw(seed, "ms", 1))), multiply_shift_batch),
        _simple(),
        *[_tornado(d) for d in (1, 2, 3, 4)],
        Family("RapidHash32", lambda df, key, out, seed: df.withColumn(out, rapid_u32(F.col(key), params.draw(seed, "rapid"))), lambda x, seed: rapid_u32_batch(x, params.draw(seed, "rapid"))),
    ]
)


#: The table families with tables filled by polynomial, the others being the same.
POLY = _named([_simple("polynomial"), *[_tornado(d, "polynomial") for d in (1, 2, 3, 4)]])


def byte_families() -> dict[str, Family]:
    """The families over byte strings."""
    rapid_batch = lambda keys, seed: over_rows(keys, lambda m: rapid64_batch(m, params.draw(seed, "rapid"))) >> np.uint64(32)
    return _named(
        [
            _on_vector("MSVec", None),
            _on_vector("TabOnMSVec", U32["SimpleTab32"]),
            *[_on_vector(f"TornadoOnMSVecD{d}", U32[f"TornadoTab32D{d}"]) for d in (1, 2, 3, 4)],
            Family("RapidHash32", lambda df, key, out, seed: df.withColumn(out, rapid32(F.col(key), params.draw(seed, "rapid"))), rapid_batch),
        ]
    )


def register(registry: dict[str, Family], name: str, apply: Callable[[DataFrame, str, str, int], DataFrame], batch=None) -> dict[str, Family]:
    """A registry with one more family."""
    return registry | {name: Family(name, apply, batch)}
