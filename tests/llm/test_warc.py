"""Archives with and without index, in byte ranges, and odd pages."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from hashloom.llm.warc import WarcReader, _Stream, page_of, read_warc, with_revisits, write_warc  # noqa: E402


def parts(folder, pattern="part-*"):
    return sorted(folder.glob(pattern))


def columns(df):
    return sorted((r.record_id or "", r.record_type, r.target_uri or "", r.http_length, r.payload_digest, r.refers_to or "", hashlib.sha1(bytes(r.payload or b"")).hexdigest()) for r in df.collect())


def test_ranges_index_and_plain_reading_agree(spark, tmp_path):
    rng = random.Random(5)
    pages = [(i, f"http://h{i % 3}/{i}", "".join(rng.choice("ab<>é\r\n") for _ in range(rng.choice([0, 3, 200, 20_000])))) for i in range(120)]
    pages += [(500 + i, "same", "x" * 3_000_000) for i in range(3)]  # very long and repeated
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for how in ("gzip", "none"):
        folder = tmp_path / how
        write_warc(with_revisits(df), f"file://{folder}", compression=how)
        assert len(parts(folder)) == 3 and not list(folder.glob("_staging*"))
        whole = columns(read_warc(spark, f"file://{folder}"))
        assert len(whole) == len(pages)
        cut = read_warc(spark, f"file://{folder}", splitBytes=5000, batchBytes=3000)
        assert cut.rdd.getNumPartitions() > 3 and columns(cut) == whole
        one = read_warc(spark, f"file://{parts(folder)[0]}")
        assert 0 < one.count() < len(pages)
        bare = columns(read_warc(spark, f"file://{folder}", payload="false"))
        assert [r[:6] for r in bare] == [r[:6] for r in whole]
        for index in folder.glob("_part-*"):
            index.unlink()
        for crc in folder.glob(".*"):
            crc.unlink()
        assert columns(read_warc(spark, f"file://{folder}", splitBytes=5000)) == whole
    # Any gzip reader takes the members one after another.
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in parts(tmp_path / "gzip"))
    assert raw.count(b"WARC/1.1\r\n") == len(pages)


def test_a_filter_reads_only_what_passes(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo

    pages = [(i, "u", ("x" if i % 2 else f"{i} ") * 500) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    write_warc(with_revisits(df), f"file://{tmp_path}/w")
    made, streams = [], _Stream.__init__
    monkeypatch.setattr(_Stream, "__init__", lambda self, raw, *a: (made.append(raw.getbuffer().nbytes), streams(self, raw, *a))[1])
    reader = WarcReader({"path": f"file://{tmp_path}/w", "splitBytes": "2000"})
    assert not list(reader.pushFilters([EqualTo(("record_type",), "revisit")]))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    size = parts(tmp_path / "w")[0].stat().st_size
    assert len(rows) == len(made) == 99 and sum(made) < size and {r["record_type"] for r in rows} == {"revisit"}


def test_odd_pages(spark, tmp_path):
    pages = [(None, "a", "x", "p"), (None, "a", "x", "p"), (1, " b\r\nWARC-Type: evil ", "x", "p"), (1, "b", "x", "p"), (2, None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").withColumns({"record": F.lit(1), "record_type": F.lit("z"), "payload_digest": F.lit(0)})
    write_warc(with_revisits(df), f"file://{tmp_path}/w")
    got = read_warc(spark, f"file://{tmp_path}/w").withColumn("id", page_of("record_id")).collect()
    assert sorted((r.id or "", r.record_type, r.refers_to or "", r.target_uri or "") for r in got) == [
        ("", "revisit", "<urn:page:1>", "a"),
        ("", "revisit", "<urn:page:1>", "a"),
        ("1", "response", "", "b"),
        ("1", "response", "", "b WARC-Type: evil"),
        ("2", "response", "", ""),
    ]


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_members_inflate_in_steps(step):
    import io

    data = [b"head\r\n\r\n" + b"y" * n for n in (0, 1, 100_000)]
    raw = b"".join(gzip.compress(d) for d in data[:2]) + gzip.compress(data[2])
    s = _Stream(io.BytesIO(raw), True, step)
    assert s.until(b"\r\n\r\n") == b"head" and s.until(b"\r\n\r\n") == b"head"
    assert s.take(1) == b"y" and s.until(b"\r\n\r\n") == b"head"
    s.skip(40_000)
    assert s.take(60_000) == b"y" * 60_000 and s.until(b"x") is None
