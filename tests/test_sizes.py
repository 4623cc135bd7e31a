"""Registered queries do the whole job: the published sizes, not smaller ones."""

import os

import pytest

from hashloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_words_and_pool(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    n = sum(len(t.split()) for t in texts)
    assert 5_000 < n < 1_000_000 and QUERIES["first_words"](spark, SF).count() == n
    rows = QUERIES["joined_words"](spark, SF).collect()
    assert sum(len(r.text.split(" ")) for r in rows) == n and len(rows) == -(-n // 10_000)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    drawn = QUERIES["pool_stream"](spark, SF)
    assert drawn.count() == drawn.select("pos").distinct().count() == 500_000
    assert drawn.select("key").distinct().count() == orders.select("o_custkey").distinct().count()


def test_repetitions(spark):
    rows = QUERIES["accuracy_oph_a2"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.function, {})[r.rep] = r.relerr
    assert all(sorted(x) == list(range(1, 21)) and len(set(x.values())) > 1 for x in by.values())
