import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hashloom.functions import families as fam
from hashloom.functions import params
from hashloom.operators import exact, metrics, sketches
from hashloom.plans import experiments
from hashloom.sources import datasets, extract


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.randrange(300),) for _ in range(3000)], "key long").cache()


def test_bottom_k_exact_branch_merge_and_errors(stream):
    h = fam.U32["MultShift"].apply(stream, "key", "h", 1)
    state = sketches.bottom_k(h, "h", 1000)
    assert sketches.bottom_k_estimate(state, "h", 1000).first().estimate == h.select("h").distinct().count()
    parts = [sketches.bottom_k(h.filter(F.col("key") % 2 == i), "h", 50) for i in (0, 1)]
    whole = {r.h for r in sketches.bottom_k(h, "h", 50).collect()}
    assert {r.h for r in sketches.bottom_k_merge(parts, "h", 50).collect()} == whole
    grouped = sketches.bottom_k(h.withColumn("g", F.col("key") % 2), "h", 50, ["g"])
    assert {r.h for r in grouped.filter("g = 0").collect()} == {r.h for r in parts[0].collect()}
    with pytest.raises(ValueError):
        sketches.bottom_k(h, "h", 0)


def test_bottom_k_zero_hash_is_infinite(spark):
    df = spark.createDataFrame([(0,)], "h long")
    assert sketches.bottom_k_estimate(df, "h", 1).first().estimate == float("inf")


def test_count_min_invariants(stream):
    rows = [("key", lambda c, r=r: fam.row_hash(c, params.draw(3, "a", r), params.draw(3, "b", r))) for r in range(3)]
    counters = sketches.count_min(stream, rows, 64)
    assert {r.n for r in counters.groupBy("row").agg(F.sum("cnt").alias("n")).collect()} == {3000}
    freq = exact.frequencies(stream, "key")
    est = sketches.count_min_estimate(freq, "key", rows, 64, counters).join(freq, "key")
    assert est.filter("est < freq").count() == 0
    counted = sketches.count_min(freq, rows, 64, "freq")
    assert counted.exceptAll(counters.select(counted.columns)).count() == 0
    halves = [sketches.count_min(stream.filter(F.col("key") % 2 == i), rows, 64) for i in (0, 1)]
    assert sketches.count_min_merge(halves).exceptAll(counters).count() == 0
    with pytest.raises(ValueError):
        sketches.count_min(stream, rows, 0)


def test_oph(stream):
    h = fam.U32["TornadoTab32D4"].apply(stream, "key", "h", 2)
    s = sketches.oph(h, "h", 50)
    assert sketches.oph_jaccard(s, s).first().jaccard == 1.0
    empty = sketches.oph(h.limit(0), "h", 50)
    assert sketches.oph_jaccard(empty, empty).first().jaccard == 1.0
    sides = h.withColumn("side", (F.col("key") >= 150).cast("int"))
    a, b = (sketches.oph(sides.filter(F.col("side") == i), "h", 50) for i in (0, 1))
    assert sketches.oph_jaccard(a, b).first() == sketches.oph_jaccard_sides(sides, "h", 50).first()
    assert sketches.oph_merge([a, b]).exceptAll(s).count() == 0
    with pytest.raises(ValueError):
        sketches.oph(h, "h", 0)


def test_exact_and_set_semantics(stream, spark):
    k = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (2, 1), (3, 1)], "key long, side int")
    r = exact.set_sizes(k, "key").first()
    assert (r.n_a, r.n_b, r.n_both, r.n_any) == (2, 2, 1, 3) and abs(r.jaccard - 1 / 3) < 1e-12
    assert exact.set_sizes(k.limit(0), "key").first().jaccard == 1.0
    assert exact.union_size(2, 2, 1) == 3
    want = Counter(r.key for r in stream.collect())
    assert {r.key: r.freq for r in exact.frequencies(stream, "key").collect()} == want


def test_a1_goldens(spark):
    s = datasets.a1(spark, 500_000).cache()
    f = exact.frequencies(s, "key").agg(F.count(F.lit(1)).alias("d"), F.max("freq").alias("m")).first()
    assert (f.d, f.m) == (125_000, 73)
    assert s.filter("pos >= 250000").agg(F.max("key")).first()[0] == 7022
    r = exact.set_sizes(datasets.split(s, 0xC0FFEE), "key").first()
    assert (r.n_a, r.n_b, r.n_both, r.n_any, round(r.jaccard, 6)) == (95_570, 95_468, 66_038, 125_000, 0.528304)
    assert [x.key for x in datasets.a1(spark, 5).orderBy("pos").collect()] == [1, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        datasets.a1(spark, 0)


def test_accuracy_of_estimates(spark):
    s = datasets.a1(spark, 20_000)
    rows = experiments.bottom_k_accuracy(s, "key", [fam.U32["TornadoTab32D4"], fam.U32["RapidHash32"]], k=500, reps=6).collect()
    assert len(rows) == 12 and all(abs(r.relerr) < 0.25 for r in rows)
    assert abs(sum(r.relerr for r in rows) / 12) < 0.08
    again = experiments.bottom_k_accuracy(s.repartition(3), "key", [fam.U32["TornadoTab32D4"], fam.U32["RapidHash32"]], k=500, reps=6)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_pools_draws_and_binary(spark):
    p = datasets.pool(spark.createDataFrame([(i * 3, i) for i in range(40)], "key long, o long"), ["o"], 10)
    s = datasets.sample_stream(p, 200, 5)
    assert s.count() == 200 and {r.key for r in s.collect()} <= {i * 3 for i in range(10)}
    with pytest.raises(ValueError):
        datasets.draws(spark, 0)
    df = spark.createDataFrame([(bytearray(b"\x01\0\0\0\xff\xff\xff\xff\x07"),)], "content binary")
    assert [r.key for r in datasets.u32_from_binary(df).orderBy("idx").collect()] == [1, 2**32 - 1]


def test_extraction(spark, tmp_path):
    a, b = "a" * 40, "B" * 40
    rows = spark.createDataFrame([(f'[{{"x": "{a}"}}, {{"y": [1, "see {b}."]}}]',), (f'{{"events": [{{"z": "{a}"}}]}}',), ("not json " + "c" * 40,)], "value string")
    assert [r.sha for r in extract.event_shas(rows).collect()] == [a, b.lower()]
    assert extract.json_events(rows).count() == 3
    words = spark.createDataFrame([(1, " one  two"), (2, ""), (3, "three four")], "doc_id long, text string")
    assert [r.word for r in datasets.first_words(words, 3).orderBy("pos").collect()] == ["one", "two", "three"]
    extract.write_words(datasets.first_words(words, 3), f"file://{tmp_path}/w")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/w").collect()) == ["one", "three", "two"]


def test_metrics_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, 0.5), ("A", 2, 0.5), ("MultShift", 1, 9.0)], "function string, rep int, relerr double")
    m = {r.function: r for r in metrics.summary(rows).collect()}
    assert m["A"].sd == 0 and m["A"].m6 == 0
    lim = metrics.limits(rows, exclude=["MultShift"]).first()
    assert lim.lo < 0.5 < lim.hi < 0.6
    assert metrics.limits(rows.filter("function = 'MultShift'"), exclude=["MultShift"]).first().hi > 8
    extract.write_accuracy(rows, f"file://{tmp_path}/acc")
    assert extract.read_accuracy(spark, f"file://{tmp_path}/acc").count() == 3
    assert extract.required(rows, ["absent"]).count() == 0
    timed = spark.createDataFrame([("A", 10, 2, 1.0, 5), ("A", 10, 2, 3.0, 5)], "function string, n long, loops long, sec double, checksum long")
    t = metrics.throughput(timed).first()
    assert t.sec == 2.0 and t.checksum == 0 and t.ns_per_hash == 1e8
    extract.write_speed(metrics.throughput(timed), f"file://{tmp_path}/speed")
    assert extract.read_speed(spark, f"file://{tmp_path}/speed").first().ns_per_hash == 1e8
