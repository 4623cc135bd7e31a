"""The experiment catalog: accuracy over repeated seeds.

The distinct keys pass through an Arrow function that hashes them under the parameters of
every family and repetition and keeps sketch state, one for each, over all batches of its
task; states meet by :func:`states.merge`.  So a task sends states and no row for a key,
and the plan is of one size whatever the number of repetitions.  Ground truth is computed
once.  Null keys are no keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions import params
from hashloom.functions.families import Family, loaded
from hashloom.functions.u64 import M32
from hashloom.operators import exact, metrics, states
from hashloom.sources.shared import written

FUNCTION = ["function", "rep"]
Job = tuple[str, int, int, Family]
#: Bytes of counters that a task holds and that are sent to all: more take more passes.
MATRIX_BYTES = 64 << 20


def _merged(rows: DataFrame, n: int, step: Callable, sketch) -> DataFrame:
    """(job, state) of ``n`` states over all rows; ``step(states, batch)`` adds a batch."""
    return states.merge(rows.mapInArrow(states.sent(n, step, sketch), "job int, part int, state binary"), sketch, ["job"], part="part")


def _named(frame: DataFrame, jobs: Sequence[Job]) -> DataFrame:
    """Adds function and repetition to rows of (job, ...)."""
    names = frame.sparkSession.createDataFrame([(j, name, rep) for j, (name, rep, *_) in enumerate(jobs)], "job int, function string, rep int")
    return frame.join(F.broadcast(names), "job")


def _jobs(families: Sequence[Family], reps: int, seed: int) -> list[Job]:
    return [(f.name, rep, params.draw(seed, "rep", rep), f) for rep in range(1, reps + 1) for f in families]


def bottom_k_accuracy(stream: DataFrame, key: str, families: Sequence[Family], k: int = 24_500, reps: int = 20, seed: int = 1) -> DataFrame:
    """(function, rep, relerr) of the distinct count.  A task sends k hashes for each
    family and repetition."""
    jobs, sketch = _jobs(families, reps, seed), states.BottomK(k)

    def add(held, batch):
        keys = loaded(batch.column(0))
        for j, (_, _, start, family) in enumerate(jobs):
            held[j] = sketch.add(held[j], family.batch(keys, start))

    keys = stream.select(key).dropna()
    est = _named(_merged(keys.distinct(), len(jobs), add, sketch), jobs).withColumn("estimate", states.estimate(F.col("state"), sketch))
    true = exact.distinct_count(keys, key)  # one row
    return est.crossJoin(F.broadcast(true)).select(*FUNCTION, metrics.relative_error(F.col("estimate"), F.col("n_distinct")).alias("relerr"))


def _rows_of(keys, job: Job, depth: int, seed: int, direct: bool):
    """The hashes of each row of a Count-Min sketch."""
    import numpy as np

    _, rep, start, family = job
    h = None if direct else family.batch(keys, start)
    for r in range(depth):
        if direct:
            yield family.batch(keys, params.draw(params.draw(seed, "row", r), "rep", rep))
        else:
            a, b = (np.uint64(params.draw(seed, f"row_{x}", rep * depth + r) & M32) for x in "ab")
            yield ((a | np.uint64(1)) * h + b) & np.uint64(M32)


def count_min_accuracy(stream: DataFrame, key: str, families: Sequence[Family], width: int = 32_768, depth: int = 3, reps: int = 20, seed: int = 1, direct: bool = True, matrix_bytes: int = MATRIX_BYTES) -> DataFrame:
    """(function, rep, relerr): mean over distinct keys.  ``direct``: each row is the family
    under parameters of its own; otherwise the family's hash goes through a row hash.

    Families and repetitions go in rounds of as many as ``matrix_bytes`` hold.  In a round
    tasks count into dense arrays, these are merged and sent to all, and a second pass over
    the keys looks its estimates up and sends sums of errors."""
    import numpy as np

    freq = written(exact.frequencies(stream.select(key).dropna(), key).select(key, "freq"), "freq")
    sketch, spark = states.CountMinRow(width), stream.sparkSession
    jobs, per, parts = _jobs(families, reps, seed), max(1, matrix_bytes // (depth * width * 8)), []
    for begin in range(0, len(jobs), per):
        some = jobs[begin : begin + per]

        def add(held, batch, some=some):
            keys, weights = loaded(batch.column(0)), batch.column(1).to_numpy()
            for j, job in enumerate(some):
                for r, h in enumerate(_rows_of(keys, job, depth, seed, direct)):
                    held[j * depth + r] = sketch.add(held[j * depth + r], h, weights)

        counters = np.zeros((len(some) * depth, width), np.uint32)  # no more than matrix_bytes
        for row in _merged(freq, len(counters), add, sketch).collect():
            counters[row.job] = np.frombuffer(row.state, sketch.dtype)
        sent = spark.sparkContext.broadcast(counters)

        def errors(batches, some=some, sent=sent):
            import pyarrow as pa

            sums, n = np.zeros(len(some)), 0
            for batch in batches:
                keys, true = loaded(batch.column(0)), batch.column(1).to_numpy()
                n += len(true)
                for j, job in enumerate(some):
                    cells = [sent.value[j * depth + r][sketch.cells(h)] for r, h in enumerate(_rows_of(keys, job, depth, seed, direct))]
                    sums[j] += ((np.minimum.reduce(cells) - true.astype(np.float64)) / true).sum()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some]), pa.array([x[1] for x in some], pa.int32()), pa.array(sums), pa.array([n] * len(some), pa.int64())], names=[*FUNCTION, "err", "n"])

        parts.append(freq.mapInArrow(errors, "function string, rep int, err double, n long"))
    sums = reduce(DataFrame.unionByName, parts).groupBy(*FUNCTION).agg(F.sum("err").alias("err"), F.sum("n").alias("n"))
    return sums.filter("n > 0").select(*FUNCTION, (F.col("err") / F.col("n")).alias("relerr"))


def oph_accuracy(stream: DataFrame, key: str, families: Sequence[Family], m: int = 200, reps: int = 20, seed: int = 1) -> DataFrame:
    """(function, rep, relerr) of the Jaccard similarity of sides 0 and 1.  A task sends two
    arrays of m minima for each family and repetition."""
    jobs, sketch = _jobs(families, reps, seed), states.OnePermutation(m)

    def add(held, batch):
        keys, side = loaded(batch.column(0)), batch.column(1).to_numpy()
        for j, (_, _, start, family) in enumerate(jobs):
            h = family.batch(keys, start)
            for s in (0, 1):
                held[2 * j + s] = sketch.add(held[2 * j + s], h[side == s])

    keys = stream.select(key, "side").dropna().distinct()
    of = lambda s: F.max(F.when(F.col("job") % 2 == s, F.col("state")))
    pair = _merged(keys, 2 * len(jobs), add, sketch).groupBy(F.floor(F.col("job") / 2).cast("int").alias("job")).agg(of(0).alias("a"), of(1).alias("b"))
    est = _named(pair, jobs).withColumn("jaccard", states.compare(F.col("a"), F.col("b"), sketch.jaccard, sketch))
    true = exact.set_sizes(keys, key).select(F.col("jaccard").alias("true"))  # one row
    return est.crossJoin(F.broadcast(true)).select(*FUNCTION, metrics.jaccard_error(F.col("jaccard"), F.col("true")).alias("relerr"))
