"""Mixing: targets by water filling, samples near them, Pareto inclusion, odd rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hashloom.llm import mixing
from hashloom.llm.shared import written


def targets(sizes, weights, share=1.0, repeats=3):
    total, done = sum(sizes.values()) * share, {}
    while True:
        rest = [s for s in sizes if s not in done]
        level = (total - sum(done.values())) / (sum(weights[s] for s in rest) or 1)
        over = [s for s in rest if level * weights[s] >= repeats * sizes[s]]
        if not over:
            return done | {s: level * weights[s] for s in rest}
        done |= {s: float(repeats * sizes[s]) for s in over}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_targets_and_samples(spark):
    rng = random.Random(3)
    shape = {"a": 400, "b": 3, "c": 60, "d": 25, None: 12, "é": 1}
    rows, n = [], 0
    for source, count in shape.items():
        for _ in range(count):
            rows.append((n, " ".join(["w"] * int(rng.paretovariate(1.1) * 3) or ["w"]), source, "clash"))
            n += 1
    rows += [(n, None, "a", ""), (n + 1, "", "c", ""), (n + 2, " \t\n", "empty", ""), (None, "one two", "a", ""), (None, "three", "a", "")]
    df = docs_of(spark, rows)
    got = mixing.mix(df, mixing.cycled((1, 2, 3))).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums: dict = {}
    for _, t, s, _ in rows:
        sums[s] = sums.get(s, 0) + size(t)
    order = sorted((s for s in sums if s is not None)) + [None]
    want = targets(sums, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    for s in sums:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sums[s] and r.target == pytest.approx(want[s]) and r.taken in (r.size * k for k in range(4)) for r in mine)
        taken, largest = sum(r.taken for r in mine), max(r.size for r in mine)
        assert abs(taken - want[s]) <= largest / 2 and taken <= 3 * sums[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), mixing.cycled((1, 2, 3))).collect()))
    copies = mixing.copies_of(df, mixing.mix(df, mixing.cycled((1, 2, 3))))
    assert copies.count() == sum(r.copies for r in got) and copies.columns == [*df.columns, "copy"]


def test_importance_gives_unequal_probabilities(spark):
    # Documents of one size, due 0.2 to 1.8 copies: each is drawn about as often as it is due.
    n, runs = 600, 4
    rows = [(i, "word word", "s", str(i % 5)) for i in range(n)]
    df = docs_of(spark, rows).withColumn("q", (F.col("size").cast("double") + 1) / 5)
    due = {i: min(3.0, (i % 5 + 1) / 5 / 0.6) for i in range(n)}
    count = dict.fromkeys(range(n), 0)
    for k in range(runs):
        got = mixing.mix(df, mixing.cycled((1,)), importance=F.col("q"), seed=f"run {k}").collect()
        assert sum(r.copies for r in got) == n
        for r in got:
            assert math.floor(due[r.doc_id] + 1e-9) <= r.copies <= math.ceil(due[r.doc_id] - 1e-9)
            count[r.doc_id] += r.copies
    for c in range(5):
        mean = sum(count[i] for i in range(n) if i % 5 == c) / (n / 5) / runs
        assert abs(mean - due[c]) < 0.12


def test_importance_up_to_the_cap(spark):
    rows = written(spark.createDataFrame([("g", w, c) for w, c in [(10.0, 3.0), (1.0, 3.0), (0.0, 3.0), (2.0, 6.0)]] + [("h", 1.0, 1.0)], "key string, w double, c double"), "t")
    amounts = written(spark.createDataFrame([("g", 9.0), ("h", 5.0)], "key string, amount double"), "t")
    got = {r.key: r.level for r in mixing.levels(rows, "key", "w", "c", amounts).collect()}
    assert got["g"] == pytest.approx(2.0) and got["h"] == math.inf
    assert sum(min(c, got["g"] * w) for w, c in [(10.0, 3.0), (1.0, 3.0), (0.0, 3.0), (2.0, 6.0)]) == pytest.approx(9.0)


def test_odd_tables(spark):
    df = docs_of(spark, [(1, "a b c", "s", "")] * 5 + [(None, None, None, None)] * 3)
    got = mixing.mix(df, mixing.cycled((1, 2, 3))).collect()
    assert len(got) == 8 and {r.taken for r in got if r.source == "s"} == {3} and all(r.taken == 0 and r.target == 0 for r in got if r.source is None)
    long = docs_of(spark, [(1, "w " * 500_000, "s", ""), (2, "w", "t", "")])
    got = {r.doc_id: r for r in mixing.mix(long, mixing.cycled((1, 1))).collect()}
    assert got[1].size == 500_000 and got[2].target == 3.0 and got[2].taken == 3
    empty = mixing.mix(df.limit(0), mixing.cycled((1, 2)))
    assert empty.columns[0] == "doc_id" and empty.count() == 0
