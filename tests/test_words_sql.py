"""Hashes of words against exact integers, where the SQL sums products as doubles."""

import pytest

import model
from hashloom.functions import families as fam
from hashloom.functions import params
from hashloom.plans.catalog import ORACLE, QUERIES, SEED

#: Words of check_l whose rounded sum falls on the other side of a multiple of 2^32, and others.
ROUNDED = ["AUXON.!!", "oftionnding.", "thateroneati"]
OTHERS = ["a", "abc", "word", "hello", "international"]


@pytest.mark.parametrize("name", [n for n in fam.byte_families() if n != "RapidHash32"])
def test_words_are_hashed_exactly(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, " ".join(ROUNDED)), (2, " ".join(OTHERS))], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = params.coefficients(SEED)
    then = {"MSVec": lambda v: v, "TabOnMSVec": lambda v: model.simple(v, params.simple_table(SEED))}.get(name) or (lambda v: model.tornado(v, params.tornado_table(SEED, int(name[-1]))))
    want = {w: then(model.ms_vector(w.encode(), c)) for w in ROUNDED + OTHERS}
    assert {r.key: r.h for r in QUERIES[f"hash_r2_{name.lower()}"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert con.sql("SELECT typeof(list_sum([1::UHUGEINT]))").fetchall() == [("DOUBLE",)]
    rounded = dict(con.sql(ORACLE[f"hash_r2_{name.lower()}"]).fetchall())
    assert {w for w in want if rounded[w] != want[w]} == set(ROUNDED)
