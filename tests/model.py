"""A plain big-integer model of the hash families, from their definitions."""

from hashloom.functions.families import SECRET

M64 = (1 << 64) - 1


def ms(x, a, b):
    return (((a | 1) * x + b) & M64) >> 32


def ms_vector(key, coeffs):
    total, n = 0, len(key) // 4
    for i in range(n):
        total += int.from_bytes(key[4 * i : 4 * i + 4], "little") * coeffs[i % 8]
    rest = key[4 * n :]
    if rest:
        last = {1: lambda: rest[0], 2: lambda: int.from_bytes(rest, "little"), 3: lambda: (int.from_bytes(rest[:2], "little") << 8) | rest[2]}[len(rest)]()
        total += last * coeffs[n % 8]
    return (total & M64) >> 32


def simple(x, t):
    return t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]


def tornado(x, t):
    h = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ (x >> 24)
    for more in t[3:]:
        c, h = h & 255, h >> 8
        h ^= more[c]
    return h & 0xFFFFFFFF


def mix(a, b):
    p = a * b
    return (p >> 64) ^ (p & M64)


def rapid(key, seed):
    n = len(key)
    r = lambda at, k=8: int.from_bytes(key[at : at + k], "little")
    seed ^= mix(seed ^ SECRET[0], SECRET[1]) ^ n
    if n == 0:
        a = b = 0
    elif n < 4:
        a, b = key[0] << 56 | key[n >> 1] << 32 | key[-1], 0
    elif n <= 16:
        d = (n & 24) >> (n >> 3)
        a, b = r(0, 4) << 32 | r(n - 4, 4), r(d, 4) << 32 | r(n - 4 - d, 4)
    else:
        p, left = 0, n
        if left > 48:
            s1 = s2 = seed
            while left >= 48:
                seed, s1, s2 = mix(r(p) ^ SECRET[0], r(p + 8) ^ seed), mix(r(p + 16) ^ SECRET[1], r(p + 24) ^ s1), mix(r(p + 32) ^ SECRET[2], r(p + 40) ^ s2)
                p, left = p + 48, left - 48
            seed ^= s1 ^ s2
        if left > 16:
            seed = mix(r(p) ^ SECRET[2], r(p + 8) ^ seed ^ SECRET[1])
            if left > 32:
                seed = mix(r(p + 16) ^ SECRET[2], r(p + 24) ^ seed)
        a, b = r(p + left - 16), r(p + left - 8)
    p = (a ^ SECRET[1]) * (b ^ seed)
    return mix((p & M64) ^ SECRET[0] ^ n, (p >> 64) ^ SECRET[1])
