"""The hash families in SQL that has unsigned 128-bit integers, for the oracle."""

from __future__ import annotations

from hashloom.functions import params
from hashloom.functions.families import SECRET, seeded
from hashloom.functions.u64 import M32, M64, P61

TWO64 = "18446744073709551616::UHUGEINT"


def _list(values: list[int], kind: str) -> str:
    return f"([{', '.join(map(str, values))}]::{kind}[])"


def wide(x: str) -> str:
    return f"({x})::UHUGEINT"


def low64(x: str) -> str:
    return f"(({x}) % {TWO64})::UBIGINT"


def high64(x: str) -> str:
    return f"(({x}) // {TWO64})::UBIGINT"


def multiply_shift(x: str, seed: int) -> str:
    a, b = params.draw(seed, "ms", 0) | 1, params.draw(seed, "ms", 1)
    return f"(((({a}::HUGEINT * ({x}) + {b}::HUGEINT) % 18446744073709551616::HUGEINT) // 4294967296::HUGEINT)::BIGINT)"


def row_hash(x: str, a: int, b: int) -> str:
    return f"((({(a | 1) & M32}::HUGEINT * ({x}) + {b & M32}::HUGEINT) % 4294967296::HUGEINT)::BIGINT)"


def fast_range32(h: str, n: int) -> str:
    return f"((({h})::HUGEINT * {n}) // 4294967296::HUGEINT)::BIGINT"


def poly61(x: str, coeffs: list[int]) -> str:
    """A polynomial mod 2^61 - 1, the highest coefficient first, of an unsigned 64-bit expression."""
    return f"list_reduce({_list([0, *coeffs], 'UHUGEINT')}, lambda a, c: (a * (({x})::UHUGEINT % {P61}::UHUGEINT) + c) % {P61}::UHUGEINT)"


def filled(seed: int, tag: str, n: int) -> str:
    """One row with v, the list of n 64-bit values that a polynomial fills tables with."""
    half = lambda x: f"({poly61(x, params.polynomial(seed, tag))} % 4294967296::UHUGEINT)"
    return f"SELECT list(({half('2 * i')} + {half('2 * i + 1')} * 4294967296::UHUGEINT)::UBIGINT ORDER BY i) AS v FROM range({n}) r(i)"


def u32(name: str, source: str, seed: int, keep: str = "", fill: str = "counter") -> str:
    """A query of (key, h) from a query of (key); ``keep`` names more columns, each with a comma
    after it.  Tables filled by counter are constants, those filled by polynomial are computed."""
    if name == "MultShift":
        return f"SELECT {keep}key, {multiply_shift('key', seed)} AS h FROM ({source})"
    if name == "SimpleTab32":
        if fill == "counter":
            t = params.simple_table(seed)
            at = [f"{_list(t[i], 'BIGINT')}[((key >> {8 * i}) & 255) + 1]" for i in range(4)]
            return f"SELECT {keep}key, xor(xor({at[0]}, {at[1]}), xor({at[2]}, {at[3]})) AS h FROM ({source})"
        at = [f"v[{256 * i} + ((key >> {8 * i}) & 255) + 1]" for i in range(4)]
        return f"SELECT {keep}key, (xor(xor({at[0]}, {at[1]}), xor({at[2]}, {at[3]})) % 4294967296::UBIGINT)::BIGINT AS h FROM ({source}), ({filled(seed, 'simple', 1024)})"
    if name == "RapidHash32":
        s = params.draw(seed, "rapid")
        both = "(key::UBIGINT * 4294967296::UBIGINT + key::UBIGINT)"
        one = f"SELECT {keep}key, {wide(f'xor({both}, {SECRET[1]}::UBIGINT)')} * {wide(f'xor({both}, {seeded(s, 4)}::UBIGINT)')} AS p FROM ({source})"
        return _finish(one, keep, 4)
    depth = int(name[-1])
    if fill == "counter":
        t = params.tornado_table(seed, depth)
        at = lambda r, i: f"{_list(t[r], 'UBIGINT')}[({i})::BIGINT + 1]"
    else:
        source, keep = f"SELECT * FROM ({source}), ({filled(seed, 'tornado', 256 * (3 + depth))})", f"{keep}v, "
        at = lambda r, i: f"v[{256 * r} + ({i})::BIGINT + 1]"
    q = f"SELECT {keep}key, xor(xor(xor({at(0, 'key & 255')}, {at(1, '(key >> 8) & 255')}), {at(2, '(key >> 16) & 255')}), (key >> 24)::UBIGINT) AS h FROM ({source})"
    for d in range(depth):
        q = f"SELECT {keep}key, xor(h >> 8, {at(3 + d, 'h & 255')}) AS h FROM ({q})"
    return f"SELECT {keep.removesuffix('v, ') if fill != 'counter' else keep}key, (h & 4294967295)::BIGINT AS h FROM ({q})"


def _finish(product: str, keep: str, length: int) -> str:
    """From the first 128-bit product p to the upper half of the hash."""
    two = f"SELECT {keep}key, {wide(f'xor({low64("p")}, {SECRET[0] ^ length}::UBIGINT)')} * {wide(f'xor({high64("p")}, {SECRET[1]}::UBIGINT)')} AS q FROM ({product})"
    return f"SELECT {keep}key, (xor({low64('q')}, {high64('q')}) >> 32)::BIGINT AS h FROM ({two})"


def le_word(hexed: str, at: int, size: int = 4) -> str:
    """A little-endian integer of ``size`` bytes from a hex string, at a byte offset."""
    pairs = " || ".join(f"substr({hexed}, {2 * (at + k) + 1}, 2)" for k in reversed(range(size)))
    return f"CAST('0x' || {pairs} AS UBIGINT)"


def ms_vector20(hexed: str, seed: int) -> str:
    c = params.coefficients(seed)
    total = " + ".join(f"{le_word(hexed, 4 * i)}::UHUGEINT * {c[i]}::UHUGEINT" for i in range(5))
    return f"((({total}) % {TWO64}) // 4294967296::UHUGEINT)::BIGINT"


def rapid20(source: str, seed: int, keep: str = "") -> str:
    """Of (key, hexed), keys of 20 bytes."""
    s = seeded(params.draw(seed, "rapid"), 20)
    mixed = f"SELECT {keep}key, hexed, {wide(f'xor({le_word("hexed", 0, 8)}, {SECRET[2]}::UBIGINT)')} * {wide(f'xor({le_word("hexed", 8, 8)}, {(s ^ SECRET[1]) & M64}::UBIGINT)')} AS m FROM ({source})"
    start = f"SELECT {keep}key, hexed, xor({low64('m')}, {high64('m')}) AS s FROM ({mixed})"
    one = f"SELECT {keep}key, {wide(f'xor({le_word("hexed", 4, 8)}, {SECRET[1]}::UBIGINT)')} * {wide(f'xor({le_word("hexed", 12, 8)}, s)')} AS p FROM ({start})"
    return _finish(one, keep, 20)


def splitmix64(x: str) -> str:
    """A scalar expression of an unsigned 64-bit expression; each step is a list lambda, so
    that what is used twice is computed once."""
    step = lambda v, shift, c: f"list_transform([{v}], lambda y: (({wide(f'xor(y, y >> {shift})')} * {c}::UHUGEINT) % {TWO64})::UBIGINT)[1]"
    first = f"(({wide(x)} + {0x9E3779B97F4A7C15}::UHUGEINT) % {TWO64})::UBIGINT"
    last = step(step(first, 30, 0xBF58476D1CE4E5B9), 27, 0x94D049BB133111EB)
    return f"list_transform([{last}], lambda y: xor(y, y >> 31))[1]"
