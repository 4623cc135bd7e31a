"""Timed jobs over byte strings packed by length: all strings are hashed, and a state sends few."""

import numpy as np
import pytest

from hashloom.functions import families as fam
from hashloom.plans import timings
from hashloom.sources import packed

SOME = [fam.byte_families()[n] for n in ("MSVec", "TornadoOnMSVecD2", "RapidHash32")]
WORDS = [b"", b"a", b"a", "straße".encode(), b"x" * 300_000, *(f"{i % 700:x}".encode() * (i % 5) for i in range(3000))]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in [*WORDS, None, None]], "key binary").repartition(3)


def test_packing_keeps_all_strings(spark, words):
    packs = packed.packed(words, "key")
    rows = packs.collect()
    found = [bytes(r.data[i * r["size"] : (i + 1) * r["size"]]) for r in rows if r.data is not None for i in range(r.n)]
    assert sorted(found) == sorted(WORDS) and sum(r.n for r in rows if r.data is None) == 2
    assert packed.packed(words.limit(0), "key").count() == 0
    assert max(len(r.data) for r in rows if r.data is not None and r.n > 1) <= packed.PIECE


def _checked(spark, words, use):
    times = timings.timed(spark, words, "key", SOME, use, 3, rounds=1).collect()
    assert len(times) == 3 and {r.n for r in times} == {len(WORDS) + 2}
    for family in SOME:
        hashed = family.apply(words, "key", "h", 3).filter("h is not null" if use.state else "true")
        assert [r.checksum for r in times if r.function == family.name] == [use(hashed).first()[0]]


@pytest.mark.parametrize("use", [timings.raw, timings.count_min(64, 3, 9)])
def test_packed_keys_have_the_same_checksums(spark, words, use):
    _checked(spark, words, use)


@pytest.mark.parametrize("k", [40, 5000])
def test_a_task_sends_the_k_least_hashes(spark, words, k, monkeypatch):
    monkeypatch.setattr(timings, "HELD", 100)
    _checked(spark, words, timings.bottom_k(k))
    packs = packed.packed(words, "key")
    sent = timings._hashed(packs, SOME[1], 3, timings.bottom_k(k).state).selectExpr("h", "spark_partition_id() as task").collect()
    for task in {r.task for r in sent}:
        mine = [r.h for r in sent if r.task == task]
        assert len(mine) <= k and np.all(np.diff(mine) > 0)


@pytest.mark.parametrize("m", [7])
def test_a_task_sends_a_hash_for_each_bin(spark, words, m, monkeypatch):
    monkeypatch.setattr(timings, "HELD", 100)
    _checked(spark, words, timings.one_permutation(m))
    packs = packed.packed(words, "key")
    sent = timings._hashed(packs, SOME[1], 3, timings.one_permutation(m).state).selectExpr("h", "spark_partition_id() as task").collect()
    bins = [(r.task, r.h * m >> 32) for r in sent]
    assert sent and len(bins) == len(set(bins))


def test_a_task_sends_its_counters(spark, words, monkeypatch):
    monkeypatch.setattr(timings, "HELD", 100)
    use = timings.count_min(64, 3, 9)
    packs = packed.packed(words, "key")
    sent = timings._counted(packs, SOME[1], 3, use.counters).selectExpr("*", "spark_partition_id() as task").collect()
    cells = [(r.task, r.row, r.col) for r in sent]
    assert len(cells) == len(set(cells)) <= 3 * 65 * len({r.task for r in sent})
    for row in range(3):
        assert sum(r.cnt for r in sent if r.row == row) == len(WORDS) + 2
        assert sum(r.cnt for r in sent if r.row == row and r.col is None) == 2
    monkeypatch.setattr(timings, "_hashed", None)  # no hash leaves a task
    _checked(spark, words, use)
    assert timings.timed(spark, words.limit(0), "key", SOME[:1], use, 3, rounds=1).first().checksum is None
