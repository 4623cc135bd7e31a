"""Timed jobs make their stream once, and hash all of it in each run."""

from functools import reduce
from operator import xor

import pytest
from pyspark.sql import functions as F

from hashloom.functions import families as fam
from hashloom.operators import metrics, sketches
from hashloom.plans import timings


@pytest.fixture
def stream(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def key(i):
        made.add(1)
        return f"word {i % 37}".encode()

    return spark.range(500).select(key.asNondeterministic()("id").alias("key")), made


def test_the_stream_is_made_once(spark, stream):
    keys, made = stream
    some = [fam.byte_families()[n] for n in ("MSVec", "RapidHash32")]
    before = spark.conf.get(timings.BATCH_KEY)
    rows = timings.timed(spark, keys, "key", some, timings.raw, 3, rounds=2).collect()
    assert made.value == 500 and spark.conf.get(timings.BATCH_KEY) == before
    assert len(rows) == 4 and {r.n for r in rows} == {500}
    all_keys = spark.createDataFrame([(f"word {i % 37}".encode(),) for i in range(500)], "key binary")
    for f in some:
        want = reduce(xor, [r.h for r in f.apply(all_keys, "key", "h", 3).collect()])
        assert {r.checksum for r in rows if r.function == f.name} == {want}


def test_counted_hashes_have_the_same_counters(spark):
    hashed = spark.createDataFrame([(h,) for h in [5, 5, 5, 4294967295, 0, 77, 77, None]], "h long")
    use = timings.count_min(64, 3, 9)
    rows = [("h", lambda c, r=r: fam.row_hash(c, timings.params.draw(9, "row_a", r), timings.params.draw(9, "row_b", r))) for r in range(3)]
    assert use(hashed).first()[0] == metrics.checksum(sketches.count_min(hashed, rows, 64), "cnt").first()[0]
