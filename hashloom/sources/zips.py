"""Texts in zip archives: written by tasks, read member by member in pieces.

``spark.read.format("hashloom_zip").load(path)`` gives (archive, place, member, piece,
n_words, words_before, text) of the archives in a folder, or of one archive; place is the
member's in its archive's directory, as two members may have one name.  Only central
directories are read to plan; a member is a task, as a deflated one can't be entered midway,
so archives of many members (``members`` = ``all``) or many archives are many tasks.  The
default takes the largest member of each archive, the first of those of one size.

A member is inflated ``piece_bytes`` (1 MB) at a time and never held whole.  A piece ends
after white space and what comes after that opens the next one, so no word is cut; a word is
in memory whole, however long.  ``words_before`` counts the words of the member's earlier
pieces.  A bound on it from above is pushed down: inflating stops where it is reached.

Paths are opened by ``pyarrow.fs`` (local or mounted, S3, GCS, HDFS).

Defined cases: members that are empty or only white space have no words, and pieces without
words aren't given; folders in an archive aren't members; an archive or folder without members
gives no rows; hidden files (``.`` or ``_`` first) and files without ``.zip`` at their end
don't count, unless the path is a file; bytes that aren't UTF-8 are an error; null texts
aren't written.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual

from hashloom.operators.positions import running
from hashloom.sources.binary import made, opened

PIECE = 1 << 20
#: White space, as a word's bounds; the same as that of ``datasets.words``.
SPACE = b" \t\n\r\x0b\x0c"
SCHEMA = "archive string, place long, member string, piece long, n_words long, words_before long, text string"


def pieces(read, size: int) -> Iterator[bytes]:
    """What ``read(n)`` gives, in pieces of about ``size`` bytes that end after white space;
    the last one as it comes."""
    tail = []
    while data := read(size):
        end = max(data.rfind(bytes([c])) for c in SPACE) + 1
        if end:
            yield b"".join([*tail, data[:end]])
            tail = [data[end:]]
        else:
            tail.append(data)
    yield b"".join(tail)


class Raw(io.RawIOBase):
    """A file of ``pyarrow.fs`` as Python's zip reader takes it: a place before the start,
    which it tries on short archives, is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        at += (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("a place before the start")
        return self.file.seek(at)


def archive_of(file):
    """The archive in an open file of ``pyarrow.fs``."""
    from zipfile import ZipFile

    return ZipFile(io.BufferedReader(Raw(file), 1 << 16))


class MemberPartition(InputPartition):
    def __init__(self, path: str, archive: str, place: int):
        self.path, self.archive, self.place = path, archive, place


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.members, self.below = options["path"], int(options.get("piece_bytes", PIECE)), options.get("members", "largest"), None
        if self.size < 1:
            raise ValueError("piece_bytes must be at least 1")
        if self.members not in ("largest", "all"):
            raise ValueError("members must be largest or all")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("words_before",):
                most = f.value + isinstance(f, LessThanOrEqual)
                self.below = most if self.below is None else min(self.below, most)
            yield f  # Spark still applies it, row by row

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = opened(self.path)
        info, out = system.get_file_info(root), []
        if info.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name[:1] not in "._" and f.extension.lower() == "zip"]
        else:
            files = [info]
        for f in sorted(files, key=lambda f: f.base_name):
            with system.open_input_file(f.path) as raw, archive_of(raw) as archive:
                found = [(k, i.file_size) for k, i in enumerate(archive.infolist()) if not i.is_dir()]
            if self.members == "largest":
                found = sorted(found, key=lambda i: -i[1])[:1]
            out += [MemberPartition(f.path, f.base_name, k) for k, size in found if size]
        return out or [MemberPartition("", "", -1)]

    def read(self, partition: MemberPartition) -> Iterator:
        import pyarrow as pa

        if partition.place < 0 or (self.below is not None and self.below <= 0):
            return
        system, _ = opened(self.path)
        names, before, piece = SCHEMA.replace(",", "").split()[::2], 0, 0
        types = [pa.string() if t == "string" else pa.int64() for t in SCHEMA.replace(",", "").split()[1::2]]
        with system.open_input_file(partition.path) as raw, archive_of(raw) as archive:
            member = archive.infolist()[partition.place]
            with archive.open(member) as inflated:
                for data in pieces(inflated.read, self.size):
                    n = len(data.split())
                    if not n:
                        continue
                    row = [partition.archive, partition.place, member.filename, piece, n, before, data.decode("utf-8")]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)
                    before, piece = before + n, piece + 1
                    if self.below is not None and before >= self.below:
                        return


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hashloom_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def read_zips(spark: SparkSession, path: str, **options) -> DataFrame:
    """The pieces of the members of the archives in ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)
    return spark.read.format("hashloom_zip").options(**options).load(path)


def first_words_of_zips(spark: SparkSession, path: str, n: int, **options) -> DataFrame:
    """(pos, word): the first n words of all archives, in order of their names (members in
    order of their places).  No member is inflated past its first n words, and texts don't travel:
    only the members' numbers of words are added up, and sent back to the pieces."""
    some = read_zips(spark, path, **options).filter(F.col("words_before") < n)
    sizes = some.groupBy("archive", "place").agg(F.sum("n_words").alias("__n"))
    starts = running(sizes, ["archive", "place"], "__n", before="__start").filter(F.col("__start") < n).drop("__n")
    at = F.col("__start") + F.col("words_before")
    each = some.join(starts, ["archive", "place"]).filter(at < n).withColumn("__first", at)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return each.select("__first", F.posexplode(words).alias("__i", "word")).select((F.col("__first") + F.col("__i")).alias("pos"), "word").filter(F.col("pos") < n)


def write_zips(rows: DataFrame, path: str, order: Sequence[str], text: str = "text") -> int:
    """Writes ``text`` in ``order``, one to a line, an archive with one member for each range
    of rows, and returns the number of texts.  An archive is put there whole under its range's
    name, so a task that runs again leaves the same; a range without rows leaves none."""
    tie = F.xxhash64("__text")
    narrow = rows.filter(F.col(text).isNotNull()).select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(text).alias("__text")).withColumn("__tie", tie)
    keys = [*(f"__o{i}" for i in range(len(order))), "__tie"]

    def save(batches):
        from zipfile import ZIP_DEFLATED, ZipFile

        import pyarrow as pa
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        system, root = opened(path)
        name = f"part-{task.partitionId():08d}"
        temporary = f"{root}/_{name}-{task.taskAttemptId()}"
        with system.open_output_stream(temporary) as raw, ZipFile(raw, "w", ZIP_DEFLATED) as archive, archive.open(f"{name}.txt", "w", force_zip64=True) as member:
            for batch in batches:
                for t in batch.column("__text"):
                    member.write(t.as_py().encode("utf-8") + b"\n")
                    n += 1
        system.move(temporary, f"{root}/{name}.zip") if n else system.delete_file(temporary)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    made(path)
    ranges = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ranges.select("__text").mapInArrow(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
