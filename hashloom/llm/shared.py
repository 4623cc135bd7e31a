"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and the master is local (tests, a laptop) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='hashloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/hashloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again: a cut of the
    lineage that survives the loss of any executor."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame made by :func:`written` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in parents:
        if "/hashloom-" in p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str):
    """The column's UTF-8 bytes; null stays null."""
    return F.col(col).cast("binary")


#: Keys with more than one in so many of all rows are joined by broadcast: no more than
#: so many of them can be.
HOT = 4096


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, spread: list[str]) -> DataFrame:
    """``rows`` left-joined to ``lookup``, which has one row for each key and says in
    ``weight`` how many rows have it.

    A key may have a third of all rows.  Those with more than 1 / HOT of the weight, at
    most HOT, are broadcast; rows that have found theirs, or have a null key, are dealt by
    the columns ``spread`` and not by key in the join with the rest.  ``lookup`` is read
    three times, so it should be a written table."""
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    others = [c for c in lookup.columns if c not in keys and c != weight]

    def side(some: DataFrame, mark: str) -> DataFrame:
        return some.select(*[F.col(c).alias(f"__{mark}_{c}") for c in keys + others], F.lit(0).cast("long").alias(f"__{mark}"))

    hot = side(lookup.filter(F.col(weight) * HOT > total), "hot")
    cold = side(lookup.filter(F.col(weight) * HOT <= total), "cold")
    first = rows.join(F.broadcast(hot), [rows[k] == hot[f"__hot_{k}"] for k in keys], "left")
    done = F.col("__hot").isNotNull() | reduce(or_, [F.col(k).isNull() for k in keys])
    first = first.withColumn("__at", F.when(done, F.xxhash64(*spread)).otherwise(0))
    both = first.join(cold, [*[first[k] == cold[f"__cold_{k}"] for k in keys], first["__at"] == cold["__cold"]], "left")
    return both.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in others])


def plus(df: DataFrame, fields: str) -> StructType:
    """The frame's schema with more fields, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def stretches(batch, text_col: str, held_bytes: int) -> Iterator:
    """An Arrow batch in slices of at most ``held_bytes`` of text, a row at least.  Cut by
    the column's lengths, so no more than a slice is turned into Python objects at a time."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + held_bytes, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def released(run):
    """The batch function, after which its worker gives what it has freed back to the system:
    Spark keeps idle workers, and each would hold as much as its largest task took."""

    def out(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return out


# -- hashes in numpy --------------------------------------------------------------------

#: Words up to this length are hashed in numpy, longer ones by BLAKE2.
LONG_WORD = 64
_CODES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(LONG_WORD + 1)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [begin, end) of a buffer; one byte parts each from the next."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(buf, np.uint8)[begins[0] : ends[-1] + 1]
    size = ends - begins + 1
    place = np.arange(len(raw), dtype=np.int32) - np.repeat((begins - begins[0]).astype(np.int32), size)
    value = _CODES[raw] * _POWERS[np.minimum(place, LONG_WORD)]
    out = mix64(np.add.reduceat(value, begins - begins[0]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[begins[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def chained(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, each word mixed into those before it."""
    n = len(words) - k + 1
    h = mix64(words[:n] + np.uint64(k))
    for i in range(1, k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i])
    return h
