"""Files of little-endian 32-bit integers: written by tasks, read in byte ranges.

``spark.read.format("hashloom_u32").load(path)`` gives (idx, key): the integers of all
files of a folder, in order of name, with their place in all of them together.  A range of
``range_bytes`` (4 MB) is a partition, so one large file is many tasks; offsets come from
the files' sizes alone, and a range is read in pieces of ``PIECE`` bytes.  A filter on idx
from above is pushed down, so the first n integers cost no more ranges than hold them.

Paths are opened by ``pyarrow.fs`` (local or mounted, S3, GCS, HDFS).

Defined cases: a file's last bytes that aren't a whole integer are left out; an empty file
or folder gives no rows; hidden files (``.`` or ``_`` first) don't count; null keys aren't
written; keys beyond 32 bits are an error when they are written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual

RANGE, PIECE = 4 << 20, 1 << 20


def opened(uri: str):
    """The file system and the path in it of a URI."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(uri)


def made(uri: str) -> None:
    """Makes a folder, so that it is there if no task has rows."""
    system, root = opened(uri)
    system.create_dir(root, recursive=True)


class RangePartition(InputPartition):
    def __init__(self, uri: str, begin: int, end: int, first: int):
        self.uri, self.begin, self.end, self.first = uri, begin, end, first


class U32Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range, self.below = options["path"], int(options.get("range_bytes", RANGE)) // 4 * 4, None
        if self.range < 4:
            raise ValueError("range_bytes must be at least 4")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("idx",):
                most = f.value + isinstance(f, LessThanOrEqual)
                self.below = most if self.below is None else min(self.below, most)
            yield f  # Spark still applies it, row by row

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = opened(self.path)
        info = system.get_file_info(root)
        files = system.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
        out, first = [], 0
        for f in sorted((f for f in files if f.is_file and f.base_name[:1] not in "._"), key=lambda f: f.base_name):
            size = f.size // 4 * 4
            for begin in range(0, size, self.range):
                if self.below is not None and first + begin // 4 >= self.below:
                    return out or [RangePartition(f.path, 0, 0, 0)]
                out.append(RangePartition(f.path, begin, min(size, begin + self.range), first + begin // 4))
            first += size // 4
        return out or [RangePartition(root, 0, 0, 0)]

    def read(self, partition: RangePartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if partition.begin == partition.end:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.uri) as f:
            at = partition.begin
            f.seek(at)
            while at < partition.end:
                data = f.read(min(PIECE, partition.end - at))
                if not data:
                    raise OSError(f"{partition.uri} has become shorter")
                data += f.read(-len(data) % 4)
                keys = np.frombuffer(data, "<u4")
                start = partition.first + (at - partition.begin) // 4
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(keys), dtype=np.int64)), pa.array(keys.astype(np.int64))], names=["idx", "key"])
                at += len(data)


class U32Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hashloom_u32"

    def schema(self) -> str:
        return "idx long, key long"

    def reader(self, schema) -> U32Reader:
        return U32Reader(self.options)


def read_u32(spark: SparkSession, path: str, **options) -> DataFrame:
    """(idx, key) of the files in ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(U32Source)
    return spark.read.format("hashloom_u32").options(**options).load(path)


def write_u32(rows: DataFrame, path: str, order: Sequence[str], key: str = "key") -> int:
    """Writes ``key`` in ``order``, a file for each range of rows, and returns the number of
    keys.  A file has the name of its range and is put there whole, so a task that runs
    again leaves the same."""
    sorted_rows = rows.filter(F.col(key).isNotNull()).select(*order, F.col(key).alias("__key")).repartitionByRange(*order, "__key").sortWithinPartitions(*order, "__key")

    def save(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = opened(path)
        name, n = f"part-{task.partitionId():08d}.u32", 0
        temporary = f"{root}/_{name}-{task.taskAttemptId()}"
        with system.open_output_stream(temporary) as f:
            for batch in batches:
                keys = batch.column("__key").to_numpy(zero_copy_only=False).astype(np.int64)
                if len(keys) and (keys.min() < 0 or keys.max() >> 32):
                    raise ValueError("a key beyond 32 bits")
                f.write(keys.astype("<u4").tobytes())
                n += len(keys)
        system.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    made(path)
    return sorted_rows.select("__key").mapInArrow(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
