"""Hard negatives against a comparison with every row; vantage-point trees; odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, anchor_id string, q int"


def brute(rows, positives=5, negatives=10, window=(30, 90)):
    kept = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if sum(x * x for x in whole) < 1 << 52:
            kept[i, label, whole] = True
    out = []
    for a, al, av in kept:
        if a % 10:
            continue
        some = [(-sum(x * y for x, y in zip(av, v, strict=True)), i, label) for i, label, v in kept if len(v) == len(av) and i != a]
        for ps, p, _ in sorted(x for x in some if x[2] == al)[:positives]:
            fit = sorted((s, i) for s, i, label in some if label != al and window[0] * -ps <= -100 * s <= window[1] * -ps)
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def found(df, **how):
    rows = df.select("*", hardneg.quantized(F.col("embedding")).alias("vector"))
    return sorted(map(tuple, hardneg.mine(rows, F.col("vec_id") % 10 == 0, **how).collect()))


def vectors(n, dim, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, int(rng.integers(4)), [float(np.float32(x)) for x in centres[rng.integers(6)] + spread * rng.normal(size=dim)], "clash", 0) for i in range(n)]


@pytest.mark.parametrize("dim", [3, 24])
def test_equals_a_comparison_with_all(spark, monkeypatch, dim):
    # Small blocks, buckets and rounds, so that there are many of each.
    monkeypatch.setattr(hardneg, "BUCKET", 8)
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", (4 * dim + 16) * 40)
    monkeypatch.setattr(hardneg, "ANCHOR_BYTES", (4 * dim + 16) * 20)
    rows = vectors(420, dim, dim)
    same = [0.5] * dim  # one vector that a third of all rows have, so all of these tie
    rows += [(1000 + i, i % 3, same, "", 0) for i in range(180)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert found(df) == want and len(want) > 500
    assert found(df, positives=2, negatives=3, window=(50, 100)) == brute(rows, 2, 3, (50, 100))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5], "", 0), (1, 1, [1.0, 0.4], "", 0), (1, 1, [1.0, 0.4], "", 0), (2, 2, [0.5, 0.2], "", 0), (3, 2, [0.5, 0.2], "", 0),
        (4, None, [1.0, 1.0], "", 0), (5, 2, None, "", 0), (6, 2, [1.0, None], "", 0), (7, 2, [nan, 1.0], "", 0), (8, 2, [inf, 1.0], "", 0), (9, 2, [1e30, 1.0], "", 0),
        (None, 2, [0.5, 0.2], "", 0), (10, 1, [0.5], "", 0), (11, 1, [1.0], "", 0), (12, 2, [0.5], "", 0), (20, 1, [], "", 0), (21, 1, [], "", 0), (22, 3, [], "", 0),
        (0, 2, [0.6, 0.2], "", 0), (30, 9, [1.0, 1.0], "", 0), (40, 1, [-0.7, -0.1], "", 0), (50, 2, [0.0, 0.0], "", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df)
    assert got == brute(rows) and {r[0] for r in got} >= {0, 10, 20}
    assert found(df.filter("vec_id % 10 <> 0")) == [] and found(df.limit(0)) == []


def test_trees_bound_every_distance():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, size=(500, 7)).astype(float)
    top = float(np.einsum("ij,ij->i", x, x).max())
    points = hardneg.augmented(x, top)
    assert np.allclose(np.einsum("ij,ij->i", points, points), top)
    for depth in (0, 1, 4):
        order, begins, vantage, bounds = hardneg.planted(points, depth)
        assert sorted(order) == list(range(500)) and len(begins) == (1 << depth) + 1
        q = np.concatenate((x[:20], np.zeros((20, 1))), axis=1)
        d = np.linalg.norm(q[:, None] - points[None], axis=2)
        near, far = hardneg.reach(d[:, vantage], bounds, depth)
        for b in range(1 << depth):
            some = d[:, order[begins[b] : begins[b + 1]]]
            assert (some >= near[:, [b]] - 1e-6).all() and (some <= far[:, [b]] + 1e-6).all()
        if depth == 4:
            assert (near > 0).any()  # it does tell buckets apart


def test_quantized(spark):
    df = spark.createDataFrame([([0.3, -0.3, 1e30],), ([None, 1.0],), ([],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(hardneg.quantized(F.col("v"))).collect()]
    assert got[0][:2] == [76.0, -77.0] and got[1] is None and got[2] == [] and got[3] is None
