"""Binary files, words by position, and streams in append mode."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from hashloom.sources import binary, datasets
from hashloom.streaming.sketch_streams import appended, oph_windows


def test_binary_files(spark, tmp_path):
    keys = [(i, (i * 2654435761) % 2**32) for i in range(5000)] + [(7, 2**32 - 1), (5000, None)]
    path = f"file://{tmp_path}/u32"
    assert binary.write_u32(spark.createDataFrame(keys, "pos long, key long").repartition(5), path, ["pos"]) == 5001
    want = [k for _, k in sorted(k for k in keys if k[1] is not None)]
    for size in (4, 1000, 4 << 20) if len(want) < 100 else (1000, 4 << 20):
        got = binary.read_u32(spark, path, range_bytes=size)
        assert [tuple(r) for r in got.orderBy("idx").collect()] == list(enumerate(want))
    few = binary.read_u32(spark, path, range_bytes=400)
    assert few.rdd.getNumPartitions() > 40 and few.filter("idx < 250").rdd.getNumPartitions() <= 4
    assert [r.key for r in few.filter("idx < 250").orderBy("idx").collect()] == want[:250]
    assert few.filter("idx <= 250").count() == 251 and few.filter("idx < 0").count() == 0
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/a.rng").write_bytes(struct.pack("<2I", 1, 2) + b"xyz")
    (tmp_path / "odd/b.rng").write_bytes(b"")
    (tmp_path / "odd/c.rng").write_bytes(struct.pack("<I", 3))
    (tmp_path / "odd/_c").write_bytes(b"1234")
    assert [tuple(r) for r in binary.read_u32(spark, f"file://{tmp_path}/odd").orderBy("idx").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert [r.key for r in binary.read_u32(spark, f"file://{tmp_path}/odd/a.rng").collect()] == [1, 2]
    (tmp_path / "none").mkdir()
    assert binary.read_u32(spark, f"file://{tmp_path}/none").count() == 0
    assert binary.write_u32(spark.createDataFrame([], "pos long, key long"), f"file://{tmp_path}/no_rows", ["pos"]) == 0
    assert binary.read_u32(spark, f"file://{tmp_path}/no_rows").count() == 0
    with pytest.raises(Exception, match="32 bits"):
        binary.write_u32(spark.createDataFrame([(1, 2**32)], "pos long, key long"), f"file://{tmp_path}/wide", ["pos"])


def test_words_by_position(spark):
    texts = [(3, "c d\n e"), (1, " a  b "), (None, "null first"), (2, None), (5, ""), (4, "f " * 1000), (6, "last")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = [w for _, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)) for w in (t or "").split()]
    for n in (1, 4, 7, 10_000):
        got = datasets.first_words(df, n).orderBy("pos").collect()
        assert [r.pos for r in got] == list(range(min(n, len(want)))) and [r.word for r in got] == want[:n]
    twice = datasets.first_words(df.unionAll(df), 10_000).orderBy("pos").collect()
    assert len(twice) == 2 * len(want) and len({r.pos for r in twice}) == len(twice)
    halves = datasets.halved_words(df).collect()
    assert len(halves) == len(want) and sum(r.side == 0 for r in halves) == len(want) // 2
    assert {r.side for r in halves if r.doc_id in (None, 1, 3)} == {0} and {r.side for r in halves if r.doc_id == 6} == {1}
    assert datasets.halved_words(df.limit(0)).count() == 0 and datasets.first_words(df.limit(0), 5).count() == 0


def test_streams_drop_closed_windows(spark, tmp_path):
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    schema = "ts timestamp, h long"
    batches = [[(day(1, 3), 5), (day(1, 4), 2**31)], [(day(3, 1), 7)], [(day(1, 5), 1), (day(3, 2), 3)], [(day(9, 1), 9)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = appended(oph_windows(stream, "ts", "h", 2, "1 day", "1 hour"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").select(F.dayofmonth("start").alias("d"), "bin", "minhash")
        rows = sorted(map(tuple, got.collect()))
        # The first day is sent once, and what comes for it later is dropped.
        assert rows == [[], [(1, 0, 5), (1, 1, 2**31)], [(1, 0, 5), (1, 1, 2**31)], [(1, 0, 5), (1, 1, 2**31), (3, 0, 3)]][i]
