"""Zip archives: written, planned by members, read in pieces."""

import io
import random
import zipfile

import pytest

from hashloom.sources import datasets, zips


def _archive(path, members, **options):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, **options) as z:
        for name, data in members:
            z.writestr(name, data)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_pieces_cut_no_word(size):
    rng = random.Random(size)
    for text in ["", " ", "a", "a b", " \n a", "word " * 50, "x" * 300, *("".join(rng.choice("ab \t\x0b\xe9\u4e2d") for _ in range(200)) for _ in range(30))]:
        data = text.encode()
        got = list(zips.pieces(io.BytesIO(data).read, size))
        assert b"".join(got) == data
        assert [w for p in got for w in p.split()] == data.split()
        assert all(p[-1:] in zips.SPACE for p in got[:-1])


def test_members(spark, tmp_path):
    text = "one two\u00a0three  \n" * 40 + "last"
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    _archive(tmp_path / "b.zip", [("small.txt", "tiny"), ("dir/", ""), ("big.txt", text), ("blank.txt", " \n "), ("empty.txt", "")])
    _archive(tmp_path / "a.zip", [("big.txt", "first of all")])
    _archive(tmp_path / "c.zip", [])
    _archive(tmp_path / "_hidden.zip", [("x", "hidden")])
    (tmp_path / "notes.txt").write_text("no archive")
    path = f"file://{tmp_path}"
    got = zips.read_zips(spark, path, piece_bytes=50)
    rows = got.orderBy("archive", "piece").collect()
    assert {(r.archive, r.member, r.place) for r in rows} == {("a.zip", "big.txt", 0), ("b.zip", "big.txt", 2)}
    big = [r for r in rows if r.archive == "b.zip"]
    assert len(big) > 10 and "".join(r.text for r in big) == text
    assert [r.words_before for r in big] == [sum(x.n_words for x in big[:i]) for i in range(len(big))]
    assert sum(r.n_words for r in big) == len(words)
    # The bound stops inflating: no piece after it, and all before.
    few = got.filter("archive = 'b.zip' and words_before < 9").collect()
    assert [r.piece for r in few] == [r.piece for r in big if r.words_before < 9]
    every = zips.read_zips(spark, path, members="all")
    assert {(r.archive, r.member) for r in every.collect()} == {("a.zip", "big.txt"), ("b.zip", "small.txt"), ("b.zip", "big.txt")}
    for n in (0, 1, 3, 4, 10, 1000):
        want = ["first", "of", "all", *words][:n]
        found = zips.first_words_of_zips(spark, path, n, piece_bytes=50).orderBy("pos").collect()
        assert [(r.pos, r.word) for r in found] == list(enumerate(want))
    one = zips.read_zips(spark, f"file://{tmp_path}/a.zip").orderBy("piece").collect()
    assert "".join(r.text for r in one) == "first of all" and {r.archive for r in one} == {"a.zip"}
    assert zips.read_zips(spark, f"file://{tmp_path}/c.zip").count() == 0


def test_stops_early(spark, tmp_path):
    # A damaged end is not reached when the bound comes before it, and is an error otherwise.
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(50_000))
    _archive(tmp_path / "x.zip", [("t", text)])
    raw = bytearray((tmp_path / "x.zip").read_bytes())
    at = len(raw) * 3 // 4
    raw[at : at + 200] = bytes(200)
    (tmp_path / "x.zip").write_bytes(raw)
    path = f"file://{tmp_path}/x.zip"
    found = zips.first_words_of_zips(spark, path, 1000, piece_bytes=4096).orderBy("pos").collect()
    assert [r.word for r in found] == text.split()[:1000]
    with pytest.raises(Exception):
        zips.read_zips(spark, path, piece_bytes=4096).count()


def test_same_name_twice(spark, tmp_path):
    with pytest.warns(UserWarning):
        _archive(tmp_path / "x.zip", [("t", "a b"), ("t", "c")])
    found = zips.first_words_of_zips(spark, f"file://{tmp_path}/x.zip", 10, members="all").orderBy("pos").collect()
    assert [(r.pos, r.word) for r in found] == [(0, "a"), (1, "b"), (2, "c")]


def test_written_archives(spark, tmp_path):
    texts = [(3, "c d\n e"), (1, " a  b "), (None, "null first"), (2, None), (5, ""), (4, "f " * 5000), (6, "last \u4e2d")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/zips"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert zips.write_zips(df, path, ["doc_id"]) == 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "zips").iterdir())) == len(list((tmp_path / "zips").glob("part-*.zip"))) >= 2
    for n in (1, 4, 10_000):
        got = zips.first_words_of_zips(spark, path, n, piece_bytes=100)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, datasets.first_words(df, n).collect()))
    assert zips.write_zips(df.limit(0), f"file://{tmp_path}/none", ["doc_id"]) == 0
    assert zips.read_zips(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="piece_bytes must be"):
        zips.read_zips(spark, path, piece_bytes=0).count()


def test_not_utf8(spark, tmp_path):
    _archive(tmp_path / "x.zip", [("t", b"a \xff b")])
    with pytest.raises(Exception, match="utf-8"):
        zips.read_zips(spark, f"file://{tmp_path}/x.zip").count()
