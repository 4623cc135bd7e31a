"""Bottom-k, Count-Min and one-permutation hashing as relational plans.

Bottom-k and OPH are idempotent, so keys are made distinct before they are hashed;
Count-Min is linear, so keys are counted first.  All three states merge: by the k smallest
of a union, by sums, by minima, which is what Spark's partial aggregation does by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.u64 import fast_range32

SATURATED = 4294967295  # counters are 32-bit and stay at their greatest value
TWO32 = 4294967296.0


def bottom_k(df: DataFrame, h: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k smallest distinct hashes, of each group if ``by`` is given."""
    if k < 1:
        raise ValueError("k must be at least 1")
    kept = df.select(*by, h).distinct()
    if not by:
        return kept.orderBy(h).limit(k)
    # Spark turns the rank limit into a limit in each task before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(h))
    return kept.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def bottom_k_estimate(state: DataFrame, h: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, size, kth, estimate): the size if it is below k, infinity if the k-th hash is 0,
    and (k - 1) / (kth / 2^32) otherwise."""
    size, kth = F.col("size"), F.col("kth")
    estimate = F.when(size < k, size.cast("double")).when(kth == 0, F.lit(float("inf"))).otherwise((k - 1) / (kth.cast("double") / TWO32))
    return state.groupBy(*by).agg(F.count(h).alias("size"), F.max(h).alias("kth")).withColumn("estimate", estimate)


def bottom_k_merge(states: Sequence[DataFrame], h: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return bottom_k(union, h, k, by)


RowHash = Callable[[Column], Column]


def _cells(df: DataFrame, rows: Sequence[tuple[str, RowHash | None]], width: int) -> Column:
    if not rows or width < 1:
        raise ValueError("width and depth must be at least 1")
    cell = lambda r, col, f: F.struct(F.lit(r).alias("row"), fast_range32(F.col(col) if f is None else f(F.col(col)), width).alias("col"))
    return F.array(*[cell(r, col, f) for r, (col, f) in enumerate(rows)])


def count_min(df: DataFrame, rows: Sequence[tuple[str, RowHash | None]], width: int, count: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sparse counters (by, row, col, cnt).  Each row of the sketch is a hash column and a
    function of it (None: the column itself)."""
    add = F.lit(1).cast("long") if count is None else F.col(count)
    cells = df.select(*by, F.explode(_cells(df, rows, width)).alias("c"), add.alias("add"))
    return cells.groupBy(*by, "c.row", "c.col").agg(F.least(F.sum("add"), F.lit(SATURATED)).alias("cnt"))


def count_min_estimate(keys: DataFrame, key: str, rows: Sequence[tuple[str, RowHash | None]], width: int, counters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, est): the least of a key's counters; 0 for a cell that is not there."""
    asked = keys.select(*by, key, F.explode(_cells(keys, rows, width)).alias("c")).select(*by, key, "c.row", "c.col")
    return asked.join(counters, [*by, "row", "col"], "left").groupBy(*by, key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("est"))


def count_min_merge(states: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy(*by, "row", "col").agg(F.least(F.sum("cnt"), F.lit(SATURATED)).alias("cnt"))


def oph(df: DataFrame, h: str, m: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, minhash): the least hash of each of m bins; an empty bin has no row."""
    if m < 1:
        raise ValueError("the number of bins must be at least 1")
    return df.groupBy(*by, fast_range32(F.col(h), m).alias("bin")).agg(F.min(h).alias("minhash"))


def oph_merge(states: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy(*by, "bin").agg(F.min("minhash").alias("minhash"))


def oph_jaccard(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, jaccard): equal bins among those that either side has; 1.0 if none."""
    both = a.withColumnRenamed("minhash", "x").join(b.withColumnRenamed("minhash", "y"), [*by, "bin"], "full_outer")
    same, any_ = F.sum(F.when(F.col("x") == F.col("y"), 1).otherwise(0)), F.count(F.lit(1))
    return both.groupBy(*by).agg(F.when(any_ == 0, F.lit(1.0)).otherwise(same / any_).alias("jaccard"))


def oph_jaccard_sides(df: DataFrame, h: str, m: int, by: Sequence[str] = (), side: str = "side") -> DataFrame:
    """The same from one frame with a side column (0 or 1): one shuffle instead of a join."""
    if m < 1:
        raise ValueError("the number of bins must be at least 1")
    bins = df.groupBy(*by, fast_range32(F.col(h), m).alias("bin")).agg(F.min(F.when(F.col(side) == 0, F.col(h))).alias("x"), F.min(F.when(F.col(side) == 1, F.col(h))).alias("y"))
    same, any_ = F.sum(F.when(F.col("x") == F.col("y"), 1).otherwise(0)), F.count(F.lit(1))
    return bins.groupBy(*by).agg(F.when(any_ == 0, F.lit(1.0)).otherwise(same / any_).alias("jaccard"))
