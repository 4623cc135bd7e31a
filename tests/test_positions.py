"""Places and running totals against plain sorting."""

import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hashloom.operators import positions


def test_numbered_and_running_in_groups(spark):
    # One group has most rows, one key many of them; nulls in either.
    rows = [("hot" if i % 3 else None if i % 7 == 0 else f"g{i % 5}", None if i % 11 == 0 else i * 7919 % 50, i % 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    order = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])
    want = sorted(rows, key=order)
    got = positions.numbered(df, ["k", "n"], ["g"], "at", "of").collect()
    assert len(got) == len(rows)
    for g, part in itertools.groupby(want, key=lambda r: r[0]):
        part = list(part)
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["at"])
        assert [r["at"] for r in mine] == list(range(len(part))) and {r["of"] for r in mine} == {len(part)}
        assert [(r.g, r.k, r.n) for r in mine] == part
    sums = positions.running(df, ["k", "n"], "n", by=["g"])
    for r in sums.groupBy("g", "k", "n").agg({"before": "min"}).collect():
        assert r["min(before)"] == sum(x[2] for x in rows if x[0] == r.g and order(x) < order((r.g, r.k, r.n)))


def test_numbered_of_nothing_and_of_equal_rows(spark):
    df = spark.range(300).selectExpr("1 as k", "id as pos")
    assert sorted(r.pos for r in positions.numbered(df.select("k"), ["k"]).collect()) == list(range(300))
    assert positions.numbered(df, ["k"]).agg({"pos": "max"}).first()[0] == 299  # a column of that name is replaced
    assert positions.numbered(df.limit(0).select("k"), ["k"], total="n").count() == 0
    assert positions.running(df.limit(0).select("k"), ["k"], "k").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=40))
def test_running_totals(spark, rows):
    rows = [(k, a, i) for i, (k, a) in enumerate(rows)]
    got = positions.running(spark.createDataFrame(rows, "k long, a long, i long"), ["k", "i"], "a").collect()
    want, total = {}, 0
    for _, a, i in sorted(rows, key=lambda r: (r[0], r[2])):
        want[i] = total
        total += a or 0
    assert {r.i: r.before for r in got} == want
