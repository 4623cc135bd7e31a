import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import model
from hashloom.functions import families as fam
from hashloom.functions import params
from hashloom.functions.u64 import fast_range32, splitmix64, splitmix64_py

EDGES = [0, 1, 255, 256, 1 << 31, (1 << 32) - 1]
LENGTHS = [0, 1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 95, 96, 97, 100]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(x,) for x in EDGES + [rng.getrandbits(32) for _ in range(60)]], "key long").cache()


@pytest.fixture(scope="module")
def strings(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(bytearray(rng.randbytes(n)),) for n in LENGTHS for _ in range(3)], "key binary").cache()


@pytest.mark.parametrize("name", list(fam.U32))
def test_u32_families_match_the_model(numbers, name):
    seed = 9
    want = {
        "MultShift": lambda x: model.ms(x, params.draw(seed, "ms", 0), params.draw(seed, "ms", 1)),
        "SimpleTab32": lambda x: model.simple(x, params.simple_table(seed)),
        "RapidHash32": lambda x: model.rapid(x.to_bytes(4, "little"), params.draw(seed, "rapid")) >> 32,
    }.get(name) or (lambda x: model.tornado(x, params.tornado_table(seed, int(name[-1]))))
    rows = fam.U32[name].apply(numbers, "key", "h", seed).collect()
    assert [r.h for r in rows] == [want(r.key) for r in rows]


@pytest.mark.parametrize("name", list(fam.POLY))
def test_tables_filled_by_polynomial(numbers, name):
    seed, p = 9, 2**61 - 1

    def value(coeffs, x):
        return sum(c * pow(x, len(coeffs) - 1 - i, p) for i, c in enumerate(coeffs)) % p

    kind, n = ("simple", 4) if name == "SimpleTab32" else ("tornado", 3 + int(name[-1]))
    coeffs = params.polynomial(seed, kind)
    assert len(coeffs) == 100 and max(coeffs) < p
    t = [[(value(coeffs, 2 * i) % 2**32) + ((value(coeffs, 2 * i + 1) % 2**32) << 32) for i in range(256 * r, 256 * (r + 1))] for r in range(n)]
    if kind == "simple":
        t = [[v % 2**32 for v in row] for row in t]
        assert params.simple_table(seed, "polynomial") == t
    else:
        assert params.tornado_table(seed, n - 3, "polynomial") == t
    rows = fam.POLY[name].apply(numbers, "key", "h", seed).collect()
    assert [r.h for r in rows] == [model.simple(r.key, t) if kind == "simple" else model.tornado(r.key, t) for r in rows]
    again = fam.POLY[name].batch(fam.loaded(pa.array([r.key for r in rows])), seed)
    assert again.tolist() == [r.h for r in rows]


def test_polynomials(spark):
    p, rng = 2**61 - 1, random.Random(7)
    keys = [0, 1, p - 1, p, p + 1, 2**62, 2**63 - 1, -1, -(2**63), *(rng.getrandbits(63) for _ in range(40))]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "key long")
    for coeffs in ([0], [p - 1], [1, 0], [p - 1] * 5, params.polynomial(3, "x", 7)):
        got = {r.key: r.h for r in df.withColumn("h", fam.polynomial(F.col("key"), coeffs)).collect()}
        assert got.pop(None) is None
        assert got == {k: sum(c * pow(k % 2**64, len(coeffs) - 1 - i, p) for i, c in enumerate(coeffs)) % p for k in keys}
    with pytest.raises(ValueError):
        params.polynomial(1, "x", 0)
    with pytest.raises(ValueError):
        params.simple_table(1, "other")


def test_byte_families_match_the_model(strings):
    seed = 9
    c = params.coefficients(seed)
    df = strings
    for name, f in fam.byte_families().items():
        df = f.apply(df, "key", name, seed)
    for r in df.collect():
        k = bytes(r.key)
        v = model.ms_vector(k, c)
        assert r.MSVec == v
        assert r.TabOnMSVec == model.simple(v, params.simple_table(seed))
        assert r.TornadoOnMSVecD4 == model.tornado(v, params.tornado_table(seed, 4))
        assert r.RapidHash32 == model.rapid(k, params.draw(seed, "rapid")) >> 32


def test_null_keys_have_null_hashes(spark):
    df = spark.createDataFrame([(None,)], "key binary")
    assert fam.byte_families()["RapidHash32"].apply(df, "key", "h", 3).first().h is None
    assert fam.U32["TornadoTab32D2"].apply(spark.createDataFrame([(None,)], "key long"), "key", "h", 3).first().h is None


def test_splitmix_rowhash_range_and_fnv(spark, numbers):
    rows = numbers.select("key", splitmix64(F.col("key")).alias("h")).collect()
    assert [r.h & model.M64 for r in rows] == [splitmix64_py(r.key) for r in rows]
    out = numbers.select("key", fam.row_hash(F.col("key"), 0xDEADBEEF, 77).alias("r"), fast_range32(F.col("key"), 1000).alias("f")).collect()
    assert all(r.r == (0xDEADBEEF * r.key + 77) % 2**32 and r.f == r.key * 1000 >> 32 for r in out)

    def fnv(b):
        h = 2166136261
        for x in b:
            h = (h ^ x) * 16777619 % 2**32
        return h

    df = spark.createDataFrame([(bytearray(b),) for b in (b"", b"a", b"hello\xff")], "key binary")
    assert [r.h for r in df.select("key", fam.fnv1a32(F.col("key")).alias("h")).collect()] == [fnv(b) for b in (b"", b"a", b"hello\xff")]


@pytest.mark.parametrize("name", [*fam.U32, *(f"bytes {n}" for n in fam.byte_families())])
def test_plans_on_a_hash_stay_small(numbers, strings, name):
    kind, _, short = name.rpartition(" ")
    given, family = (strings, fam.byte_families()[short]) if kind else (numbers, fam.U32[short])
    h = family.apply(given, "key", "h", 1)
    want = [r.h for r in h.collect()]
    assert h.filter("h % 2 = 0").count() == sum(x % 2 == 0 for x in want)
    assert h.groupBy("h").count().count() == len(set(want))
    other = family.apply(given, "key", "g", 1).select("g").distinct()
    assert h.join(other, h.h == other.g).filter("g > 5").count() == sum(x > 5 for x in want)


@pytest.mark.parametrize("name", [*fam.U32, *(f"bytes {n}" for n in fam.byte_families())])
def test_batches_equal_columns(numbers, strings, name):
    import pyarrow as pa

    kind, _, short = name.rpartition(" ")
    given, family = (strings, fam.byte_families()[short]) if kind else (numbers, fam.U32[short])
    rows = family.apply(given, "key", "h", 11).select("key", "h").collect()
    keys = pa.array([bytes(r.key) if kind else r.key for r in rows], pa.binary() if kind else pa.int64())
    assert family.batch(fam.loaded(keys), 11).tolist() == [r.h for r in rows]


def test_rapid_default_seed_equals_the_model(strings):
    for r in strings.select("key", fam.rapid(F.col("key")).alias("h")).collect():
        assert r.h & model.M64 == model.rapid(bytes(r.key), fam.RAPID_SEED)


def test_registry_and_bad_ranges(spark, numbers):
    more = fam.register(fam.U32, "Identity", lambda df, key, out, seed: df.withColumn(out, F.col(key)))
    assert more["Identity"].apply(numbers, "key", "h", 0).filter("h <> key").count() == 0
    with pytest.raises(ValueError):
        fast_range32(F.col("key"), 0)
