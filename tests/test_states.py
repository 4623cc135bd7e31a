"""Sketch states as a column: build, merge, estimate, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.functions import families as fam
from hashloom.operators import metrics, states
from hashloom.plans import experiments


def hashes(spark, n=20_000):
    rng = np.random.default_rng(2)
    rows = [(None if i % 50 == 0 else f"g{i % 3}", None if i % 97 == 0 else int(h), i % 5) for i, h in enumerate(rng.integers(0, 1 << 32, n) // 7 * 7 % (1 << 31))]
    return rows, spark.createDataFrame(rows, "g string, h long, part int").repartition(6)


def groups(rows):
    out: dict = {}
    for g, h, _ in rows:
        if h is not None:
            out.setdefault(g, []).append(h)
    return out


@pytest.mark.parametrize("held", [64 << 20, 2000])
def test_bottom_k_states(spark, monkeypatch, held):
    monkeypatch.setattr(states, "HELD", held)  # a task that holds little sends its groups more often
    rows, df = hashes(spark)
    sketch = states.BottomK(300)
    built = states.build(df, sketch, "h", ["g"])
    got = {r.g: r for r in built.withColumn("n", states.estimate(F.col("state"), sketch)).collect()}
    for g, hs in groups(rows).items():
        want = np.unique(hs)[:300]
        assert np.array_equal(np.frombuffer(got[g].state, np.uint32), want) and got[g].n == pytest.approx(299 / (want[-1] / 2**32))
    parts = states.build(df, sketch, "h", ["g", "part"])
    again = {r.g: r.state for r in states.merge(parts, sketch, ["g"]).collect()}
    assert again == {g: r.state for g, r in got.items()}
    assert states.build(df.limit(0), sketch, "h", ["g"]).count() == 0
    assert [np.frombuffer(r.state, np.uint32).tolist() for r in states.build(df, sketch, "h").collect()] == [np.unique([h for _, h, _ in rows if h is not None])[:300].tolist()]


def test_other_states(spark):
    rows, df = hashes(spark, 3000)
    oph = states.OnePermutation(64)
    got = {r.g: np.frombuffer(r.state, np.uint64) for r in states.build(df, oph, "h", ["g"]).collect()}
    for g, hs in groups(rows).items():
        want = [min([h for h in hs if h * 64 >> 32 == b], default=1 << 32) for b in range(64)]
        assert got[g].tolist() == want
    a, b = got["g0"], got["g1"]
    assert oph.jaccard(a, a) == 1.0 and oph.jaccard(oph.empty(), oph.empty()) == 1.0 and oph.jaccard(a, oph.empty()) == 0.0 and 0 <= oph.jaccard(a, b) <= 1
    row = states.CountMinRow(128)
    got = {r.g: np.frombuffer(r.state, np.uint64) for r in states.build(df, row, "h", ["g"]).collect()}
    for g, hs in groups(rows).items():
        assert got[g].tolist() == np.bincount(np.array(hs) * 128 >> 32, minlength=128).tolist()
    full = row.add(row.empty(), np.zeros(1, np.uint64), np.array([2**33]))
    assert row.merge(full, full).max() == 2**32 - 1
    for wrong in (lambda: states.BottomK(0), lambda: states.CountMinRow(0), lambda: states.OnePermutation(0), lambda: oph.merge(a, a[:3]), lambda: states.BottomK(2).merge(a[:3].astype(np.uint32), a[:1].astype(np.uint32)), lambda: row.merge(full, full[:2])):
        with pytest.raises(ValueError):
            wrong()
    more = states.register(states.SKETCHES, "mine", states.BottomK)
    assert "mine" in more and "mine" not in states.SKETCHES and more["bottom_k"](3).k == 3


def test_moments(spark):
    rng = np.random.default_rng(4)
    data = {"a": rng.gamma(2.0, size=5000) + 1e6, "b": rng.normal(size=77), "c": np.full(10, 2.5), "d": np.array([1.0])}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)]
    df = spark.createDataFrame(rows, "function string, relerr double").repartition(7)
    got = metrics.summary(df).collect()
    assert [r.function for r in got] == sorted(data)
    for r in got:
        x = data[r.function]
        z = (x - x.mean()) / (x.std() or 1.0)
        assert (r["mean"], r.sd, r.m6) == pytest.approx((x.mean(), x.std(), (z**6).mean()), rel=1e-6)


def test_count_min_in_rounds_and_plans_without_rows_per_key(spark):
    rows = [(i * i % 700,) for i in range(4000)] + [(None,)]
    df = spark.createDataFrame(rows, "key long")
    few = [fam.U32["MultShift"], fam.U32["TornadoTab32D2"]]
    run = lambda **how: sorted(map(tuple, experiments.count_min_accuracy(df, "key", few, 64, 3, 4, **how).collect()))
    whole, rounds = run(), run(matrix_bytes=64 * 3 * 8 * 3)
    assert len(whole) == 8 and [(f, r) for f, r, _ in whole] == [(f, r) for f, r, _ in rounds]
    assert [e for *_, e in whole] == pytest.approx([e for *_, e in rounds]) and all(e > 0 for *_, e in whole)
    exact = experiments.bottom_k_accuracy(df, "key", few, 24_500, 2).collect()
    assert len(exact) == 4 and all(r.relerr == 0 for r in exact)  # fewer keys than k
    assert experiments.bottom_k_accuracy(df.limit(0), "key", few, 10, 2).count() == 0
    assert experiments.count_min_accuracy(df.limit(0), "key", few, 64, 3, 2).count() == 0
