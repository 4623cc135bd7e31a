"""Exact percentiles against sorting."""

import random

import numpy as np
import pytest

from hashloom.operators import selection


@pytest.mark.parametrize("few", [10_000, 1000, 20])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)  # with few, several rounds
    rng = random.Random(5)
    groups = {"wide": [rng.gauss(0, 1) * 10 ** rng.randint(-300, 300) for _ in range(4000)], "ties": [rng.choice([1.0, 2.0, 2.0, 2.5]) for _ in range(3000)], None: [rng.random() for _ in range(1001)], "one": [7.0], "two": [1.0, 4.0], "same": [3.0] * 50}
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("one", None, ""), ("none", None, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, rank string")
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {(r.g, r.share): r.v for r in selection.percentiles(df, "v", shares, ["g"]).collect()}
    assert len(got) == len(groups) * len(shares)
    for g, vs in groups.items():
        for p in shares:
            want = float(np.quantile(np.array(vs), p))
            assert got[g, p] == pytest.approx(want, rel=1e-12)
    assert {r.g: r.v for r in selection.median(df, "v", ["g"]).collect()}["two"] == 2.5
    assert [r.v for r in selection.median(df.filter("g = 'ties'"), "v").collect()] == [float(np.median(groups["ties"]))]
    assert selection.median(df.limit(0), "v").count() == 0


def test_nth(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "v long")
    ranks = spark.createDataFrame([(0,), (500,), (999,), (1000,), (-1,)], "rank long")
    assert sorted((r["rank"], r.v) for r in selection.nth(df, "v", ranks).collect()) == [(0, 0), (500, 500), (999, 999)]
