"""What of a large tile travels: folded signatures, and whole ones of members with a pair left."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hashloom.llm import jaccard

SHARE = (85, 100)


def _rows(sets, comp, thin, chunks=1):
    rows = []
    for k, s in enumerate(sets):
        sig = jaccard.signature(s, jaccard.width_of(len(s)))
        sig = jaccard.fold(sig, jaccard.width_of(len(s)) // 8) if thin else sig
        rows += [(7, 3, min(k % chunks, o), max(k % chunks, o), True, k, comp[k], len(s), sig.tobytes(), k % chunks) for o in range(chunks)]
    rows.sort(key=lambda r: r[:4])
    names = ["h", "band", "i", "j", "own", "rep", "comp", "n", "sig", "chunk"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@pytest.mark.parametrize("chunks", [1, 3])
def test_only_members_with_a_pair_left_get_whole_signatures(chunks):
    rng = np.random.default_rng(1)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    sets = [draw(200) for _ in range(60)]
    sets[40] = np.unique(np.r_[sets[4][:-8], draw(8)])  # linked to 4
    sets[50] = np.unique(np.r_[sets[5][:-8], draw(8)])  # as near to 5, but of its component
    comp = list(range(60))
    comp[50] = comp[5]
    members = pa.Table.from_batches(jaccard._tile_pairs(SHARE, members=True)([_rows(sets, comp, True, chunks)]))
    assert members.column_names == list(jaccard.MEMBER)
    assert set(members["rep"].to_pylist()) == {4, 40}
    pairs = lambda batch: {tuple(r.values()) for b in jaccard._tile_pairs(SHARE)([batch]) for r in b.to_pylist()}
    whole = _rows(sets, comp, False, chunks)
    left = {tuple(r[c] for c in jaccard.MEMBER) for r in members.to_pylist()}
    some = whole.filter(pa.array([tuple(r[c] for c in jaccard.MEMBER) in left for r in whole.to_pylist()]))
    assert len(some) < len(whole) and pairs(some) == pairs(whole) == {(4, 40)}


def test_a_tile_without_near_sets_has_no_members():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64)) for _ in range(50)]
    assert not list(jaccard._tile_pairs(SHARE, members=True)([_rows(sets, list(range(50)), True)]))


def test_only_signatures_of_pairs_travel(spark):
    pairs = spark.createDataFrame([(5, 9), (-7, 5)], "a long, b long")
    wanted, bits = jaccard._wanted(pairs)
    table = spark.range(-1000, 1000).select(F.col("id").alias("rep"), F.lit(b"x").alias("sig"))
    got = {r.rep for r in jaccard._passing(table, wanted, bits).collect()}
    assert {5, 9, -7} <= got and len(got) < 20
