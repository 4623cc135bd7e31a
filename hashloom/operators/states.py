"""Sketches as values: build, merge and estimate, with the state as a BINARY column.

A sketch is an object with ``empty``, ``add`` (hashes, and maybe weights, into a state),
``merge`` (of two states) and ``estimate``; states are numpy arrays of ``dtype``.  A task
keeps one state for each group over all its rows and sends that, so what is shuffled is a
state for each task and group, not rows.  States meet in two rounds: those of at most
1 / ``FAN`` of all tasks first, then what these gave, so no task merges more than about
the root of their number.

A task holds at most ``HELD`` bytes of states; with more groups it sends what it has and
goes on with empty ones.

Defined cases: null hashes or values don't count; a group of null is a group; an empty
frame gives no states; states of other parameters can't be merged (a ValueError).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN, HELD = 64, 64 << 20
SATURATED = np.uint64(0xFFFFFFFF)
TWO32 = float(1 << 32)


@dataclass(frozen=True)
class BottomK:
    """The k least distinct 32-bit hashes, sorted; estimates the number of distinct keys."""

    k: int
    dtype = np.dtype(np.uint32)

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be at least 1")

    def empty(self) -> np.ndarray:
        return np.zeros(0, np.uint32)

    def add(self, state: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if len(state) == self.k:  # the k-th hash is a threshold: few get beyond it
            hashes = hashes[hashes < state[-1]]
            if not len(hashes):
                return state
        return self.merge(state, np.unique(hashes.astype(np.uint32))[: self.k])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) > self.k or len(b) > self.k:
            raise ValueError("a state of a greater k")
        return np.union1d(a, b)[: self.k]

    def estimate(self, state: np.ndarray) -> float:
        if len(state) < self.k:
            return float(len(state))
        return float("inf") if not state[-1] else (self.k - 1) / (float(state[-1]) / TWO32)


@dataclass(frozen=True)
class OnePermutation:
    """The least hash of each of m bins; 2^32, which is no hash, marks an empty one.
    Compared with another state it estimates the Jaccard similarity."""

    m: int
    dtype = np.dtype(np.uint64)

    def __post_init__(self):
        if self.m < 1:
            raise ValueError("the number of bins must be at least 1")

    def empty(self) -> np.ndarray:
        return np.full(self.m, 1 << 32, np.uint64)

    def add(self, state: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        state, h = state.copy(), hashes.astype(np.uint64)
        np.minimum.at(state, (h * np.uint64(self.m) >> np.uint64(32)).astype(np.int64), h)
        return state

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) != len(b):
            raise ValueError("states of different numbers of bins")
        return np.minimum(a, b)

    def estimate(self, state: np.ndarray) -> float:
        """The share of bins that hold a hash."""
        return float((state < 1 << 32).mean())

    def jaccard(self, a: np.ndarray, b: np.ndarray) -> float:
        some = (a < 1 << 32) | (b < 1 << 32)
        return float((a[some] == b[some]).mean()) if some.any() else 1.0


@dataclass(frozen=True)
class CountMinRow:
    """One row of a Count-Min sketch as a dense array; counters stay at their greatest value."""

    width: int
    dtype = np.dtype(np.uint64)

    def __post_init__(self):
        if self.width < 1:
            raise ValueError("width must be at least 1")

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes.astype(np.uint64) * np.uint64(self.width) >> np.uint64(32)).astype(np.int64)

    def empty(self) -> np.ndarray:
        return np.zeros(self.width, np.uint64)

    def add(self, state: np.ndarray, hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        # In doubles, exact below 2^53: far above where counters stay.
        more = np.bincount(self.cells(hashes), weights, self.width)
        return np.minimum(state + more.astype(np.uint64), SATURATED)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) != len(b):
            raise ValueError("states of different widths")
        return np.minimum(a + b, SATURATED)

    def estimate(self, state: np.ndarray) -> float:
        """The sum of all counters: how many keys were added."""
        return float(state.sum())


@dataclass(frozen=True)
class Moments:
    """Number, mean and the central sums of the powers 2 to ``order`` of doubles, merged
    without going back to the values (Pebay's formulas)."""

    order: int = 6
    dtype = np.dtype(np.float64)

    def empty(self) -> np.ndarray:
        return np.zeros(self.order + 1)

    def add(self, state: np.ndarray, values: np.ndarray) -> np.ndarray:
        x = values.astype(np.float64)
        if not len(x):
            return state
        mean = x.mean()
        return self.merge(state, np.array([len(x), mean, *(((x - mean) ** p).sum() for p in range(2, self.order + 1))]))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = a[0], b[0]
        if not na or not nb:
            return b if not na else a
        n, d = na + nb, b[1] - a[1]
        out = [n, a[1] + d * nb / n]
        part = lambda s, q: s[q] if q > 1 else 0.0  # noqa: E731  the first central sum is 0
        for p in range(2, self.order + 1):
            cross = sum(comb(p, k) * d**k * ((-nb / n) ** k * part(a, p - k) + (na / n) ** k * part(b, p - k)) for k in range(1, p - 1))
            out.append(a[p] + b[p] + cross + (na * nb * d / n) ** p * (nb ** (1 - p) - (-1 / na) ** (p - 1)))
        return np.array(out)

    def estimate(self, state: np.ndarray) -> float:
        return float(state[1])

    def standardized(self, state: np.ndarray, p: int) -> float:
        """The mean of the p-th power of (x - mean) / deviation; a deviation of 0 divides by 1."""
        n, sd = state[0], np.sqrt(state[2] / state[0])
        return float(state[p] / n / (sd if sd > 0 else 1.0) ** p)


#: Sketches by name; :func:`register` adds one.
SKETCHES: dict[str, Callable] = {"bottom_k": BottomK, "one_permutation": OnePermutation, "count_min_row": CountMinRow, "moments": Moments}


def register(registry: dict[str, Callable], name: str, sketch: Callable) -> dict[str, Callable]:
    """A registry with one more sketch."""
    return registry | {name: sketch}


def sent(jobs: int, step: Callable, sketch) -> Callable:
    """For mapInArrow: one state for each of ``jobs`` over all batches of a task, sent as
    rows (job, part, state) at its end.  ``step(states, batch)`` adds a batch."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        states, seen = [sketch.empty() for _ in range(jobs)], False
        for batch in batches:
            if batch.num_rows:
                seen = True
                step(states, batch)
        if seen:
            part = TaskContext.get().partitionId()
            for j, s in enumerate(states):
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([part], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["job", "part", "state"])

    return run


def build(df: DataFrame, sketch, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, state): a sketch of ``value`` (hashes, or what the sketch takes) for each group."""
    groups = df.select(*by, F.col(value).alias("__value")).filter(F.col("__value").isNotNull())
    schema = T.StructType([*groups.select(*by).schema.fields, *T.StructType.fromDDL("__part int, state binary").fields])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), {}, 0

        def out():
            # In small batches: a state may be large.
            for key, s in held.items():
                yield pa.RecordBatch.from_pylist([dict(zip(by, key, strict=True)) | {"__part": part, "state": s.tobytes()}], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema([*(batch.schema.field(c) for c in by), ("__part", pa.int32()), ("state", pa.binary())])
            values = batch.column("__value").to_numpy(zero_copy_only=False)
            table = pa.Table.from_batches([batch.select(list(by))]) if by else None
            if by:
                table = table.append_column("__at", pa.array(np.arange(batch.num_rows)))
                parts = [(tuple(r[c] for c in by), np.array(r["__at_list"])) for r in table.group_by(list(by)).aggregate([("__at", "list")]).to_pylist()]
            else:
                parts = [((), slice(None))]
            for key, at in parts:
                before = held.get(key)
                held[key] = sketch.add(sketch.empty() if before is None else before, values[at])
                size += held[key].nbytes - (0 if before is None else before.nbytes)
            if size > HELD:
                yield from out()
                held, size = {}, 0
        if arrow is not None:
            yield from out()

    return merge(groups.mapInArrow(run, schema), sketch, by, part="__part")


def merge(states: DataFrame, sketch, by: Sequence[str] = (), part: str | None = None) -> DataFrame:
    """(by, state): all states of each group as one."""
    rows = states.select(*by, "state", (F.spark_partition_id() if part is None else F.col(part)).alias("__part"))
    plain = T.StructType([*rows.select(*by).schema.fields, T.StructField("state", T.BinaryType())])

    def joined(table):
        import pyarrow as pa

        out = sketch.empty()
        for s in table.column("state"):
            if s.is_valid:
                out = sketch.merge(out, np.frombuffer(s.as_buffer(), sketch.dtype))
        first = table.slice(0, 1).select([c for c in table.column_names if c not in ("state", "__part")])
        return first.append_column("state", pa.array([out.tobytes()], pa.binary()))

    # Grouped by at least one column, so an empty frame gives no group.
    some = rows.withColumn("__fan", F.pmod("__part", F.lit(FAN)))
    once = some.groupBy(*by, "__fan").applyInArrow(lambda t: joined(t.drop_columns(["__fan"])), plain).withColumn("__all", F.lit(0))
    return once.groupBy(*by, "__all").applyInArrow(lambda t: joined(t.drop_columns(["__all"])), plain)


def estimate(state: Column, sketch) -> Column:
    """The sketch's estimate of a state."""
    return measure(state, lambda s: sketch.estimate(s), sketch)


def measure(state: Column, f: Callable[[np.ndarray], float], sketch) -> Column:
    """A number from a state; null of null."""

    @F.arrow_udf(T.DoubleType())
    def run(states):
        import pyarrow as pa

        return pa.array([f(np.frombuffer(s.as_buffer(), sketch.dtype)) if s.is_valid else None for s in states], pa.float64())

    return run(state)


def compare(a: Column, b: Column, f: Callable[[np.ndarray, np.ndarray], float], sketch) -> Column:
    """A number from two states, such as :meth:`OnePermutation.jaccard`."""

    @F.arrow_udf(T.DoubleType())
    def run(x, y):
        import pyarrow as pa

        get = lambda s: np.frombuffer(s.as_buffer(), sketch.dtype)
        return pa.array([f(get(p), get(q)) if p.is_valid and q.is_valid else None for p, q in zip(x, y, strict=True)], pa.float64())

    return run(a, b)
