"""Timed jobs as data: families run in shuffled rounds, each run a row with its seconds.

A job is one family in one use (hashed alone, or put into a sketch) over one stream.  Its
result is a checksum, so nothing can be left out, and equal checksums of all rounds show
that they did the same.  The stream's keys are written once, so that a stream that is costly to
make is made once and not for each run; every run then reads and hashes all of them.  Seconds
are those of a Spark job over these keys, reading and shuffles included.

Byte strings are written packed by length and hashed in batches.  Where the use has a state, a
task keeps one over all hashes and sends the hashes in it, as the experiments do; where it has
counters, a task counts all its hashes and sends the counters.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.functions import params
from hashloom.functions.families import Family, row_hash, row_hash_batch
from hashloom.operators import exact, metrics, sketches, states
from hashloom.sources.packed import packed, unpacked
from hashloom.sources.shared import forget, written

TIMES = "function string, n long, loops int, round int, sec double, checksum long"
#: Keys in an Arrow batch of the timed jobs: a batch is hashed length by length, and in small
#: ones the calls for each length outweigh the work.  Spark's bound on its bytes stays.
BATCH, BATCH_KEY = 100_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of packed keys in an Arrow batch, and hashes that go into a state at a time: each time
#: costs as much as the state is large.
PACKS, HELD = 256, 1 << 18


@dataclass(frozen=True)
class Counters:
    """Counters of a Count-Min sketch whose rows are row hashes (a, b) of one hash."""

    rows: tuple[tuple[int, int], ...]
    width: int


@dataclass(frozen=True)
class Use:
    """The checksum of a frame of hashes ``h``.  ``state``, if given, is a sketch whose state
    keeps as many of a task's hashes as that checksum needs; with ``counters`` it is the xor
    of these, saturated."""

    checksum: Callable[[DataFrame], DataFrame]
    state: object | None = None
    counters: Counters | None = None

    def __call__(self, hashed: DataFrame) -> DataFrame:
        return self.checksum(hashed)


class Xor:
    """The xor of hashes, for what is left of hashes that are only xored."""

    def empty(self) -> np.ndarray:
        return np.zeros(1, np.uint64)

    def add(self, state: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return state ^ np.bitwise_xor.reduce(hashes)


#: Xor of all hashes.
raw = Use(lambda hashed: metrics.checksum(hashed, "h"), Xor())


def bottom_k(k: int) -> Use:
    """Xor of the k least distinct hashes."""
    return Use(lambda hashed: metrics.checksum(sketches.bottom_k(hashed, "h", k), "h"), states.BottomK(k))


def count_min(width: int, depth: int, seed: int) -> Use:
    """Xor of the counters, rows being row hashes of one hash; equal hashes are counted first."""
    drawn = tuple((params.draw(seed, "row_a", r), params.draw(seed, "row_b", r)) for r in range(depth))
    rows = [("h", lambda c, a=a, b=b: row_hash(c, a, b)) for a, b in drawn]
    return Use(lambda hashed: metrics.checksum(sketches.count_min(exact.frequencies(hashed, "h"), rows, width, "freq"), "cnt"), counters=Counters(drawn, width))


def one_permutation(m: int) -> Use:
    """Xor of the bins' minima."""
    return Use(lambda hashed: metrics.checksum(sketches.oph(hashed, "h", m), "minhash"), states.OnePermutation(m))


def _hashed(packs: DataFrame, family: Family, seed: int, state) -> DataFrame:
    """(h) of packed keys: of each, or with a state those that it keeps of each task's.
    Nulls have a null hash and don't count in a state."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sent = lambda h: pa.RecordBatch.from_arrays([h], ["h"])
        kept, held, total, seen = None if state is None else state.empty(), [], 0, False
        for batch in batches:
            for n, m in unpacked(batch):
                if m is None:
                    if state is None:
                        yield sent(pa.nulls(n, pa.int64()))
                    continue
                h = family.batch((n, [(slice(None), m)]), seed)
                if state is None:
                    yield sent(pa.array(h.view(np.int64)))
                    continue
                held.append(h)
                total, seen = total + n, True
                if total >= HELD:
                    kept, held, total = state.add(kept, np.concatenate(held)), [], 0
        if seen:  # 2^32 marks an empty bin
            kept = state.add(kept, np.concatenate(held)) if held else kept
            yield sent(pa.array(kept[kept < states.TWO32].astype(np.int64)))

    return packs.mapInArrow(run, "h long")


def _counted(packs: DataFrame, family: Family, seed: int, counters: Counters) -> DataFrame:
    """(row, col, cnt) of each task's hashes of packed keys.  Nulls count in a column of null."""
    sketch = states.CountMinRow(counters.width)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, held, total, nulls = [sketch.empty() for _ in counters.rows], [], 0, 0

        def add() -> None:
            if held:
                h = np.concatenate(held)
                for r, (a, b) in enumerate(counters.rows):
                    counts[r] = sketch.add(counts[r], row_hash_batch(h, a, b))

        for batch in batches:
            for n, m in unpacked(batch):
                if m is None:
                    nulls += n
                    continue
                held.append(family.batch((n, [(slice(None), m)]), seed))
                total += n
                if total >= HELD:
                    add()
                    held, total = [], 0
        add()
        for r, count in enumerate(counts):
            at = np.flatnonzero(count)
            cols, adds = pa.array(at), pa.array(count[at].astype(np.int64))
            if nulls:
                cols, adds = pa.concat_arrays([cols, pa.nulls(1, pa.int64())]), pa.concat_arrays([adds, pa.array([nulls], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), r, np.int32)), cols, adds], ["row", "col", "cnt"])

    return packs.mapInArrow(run, "row int, col long, cnt long")


def timed(spark: SparkSession, stream: DataFrame, key: str, families: Sequence[Family], use: Use, seed: int, rounds: int = 3, loops: int = 1) -> DataFrame:
    """A row (function, n, loops, round, sec, checksum) for each family and round; families
    come in another order in each round, after one round that isn't counted."""
    rng, out, before = random.Random(seed), [], spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(BATCH))
    try:
        if stream.schema[key].dataType == T.BinaryType() and all(f.batch for f in families):
            keys = packed(stream, key)
            n = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if use.counters is None:
                result = lambda family: use(_hashed(keys, family, seed, use.state))
            else:
                result = lambda family: metrics.checksum(sketches.count_min_merge([_counted(keys, family, seed, use.counters)]), "cnt")
            spark.conf.set(BATCH_KEY, str(PACKS))
        else:
            keys = written(stream.select(key), "keys")
            n = keys.count()
            result = lambda family: use(family.apply(keys, key, "h", seed))
        for k in range(rounds + 1):
            for family in rng.sample(list(families), len(families)):
                began = time.perf_counter()
                for _ in range(loops):
                    checksum = result(family).first()[0]
                if k:
                    out.append((family.name, n, loops, k, time.perf_counter() - began, checksum))
    finally:
        spark.conf.set(BATCH_KEY, before)
    forget(keys)
    return spark.createDataFrame(out, TIMES)


def speeds(times: DataFrame) -> DataFrame:
    """Throughput of each function from its median round, and whether all rounds agree."""
    agree = times.groupBy("function").agg(F.max("checksum").alias("checksum"), (F.min("checksum") == F.max("checksum")).alias("agree"))
    return metrics.throughput(times).drop("checksum").join(F.broadcast(agree), "function")  # a row for each function
