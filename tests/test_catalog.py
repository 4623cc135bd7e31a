"""Some of the catalog against SQL on the smallest tables; the driver runs all of it."""

import os

import pytest

from hashloom.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["bottomk_partkey", "oph_tornadotab32d3", "countmin_prehash_rapidhash32", "countmin_direct_simpletab32", "set_intersection", "summary_moments", "first_words", "zip_words", "hash_simpletab32_poly", "hash_tornadotab32d2_poly", "hash_poly61"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
