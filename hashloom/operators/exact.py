"""Exact counterparts of the sketches, with set semantics throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("n_distinct"))


def frequencies(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("freq"))


def set_sizes(df: DataFrame, key: str, side: str = "side") -> DataFrame:
    """Distinct keys on either side, on both, on any, and their Jaccard similarity (1.0 if
    there are none); one shuffle, by key."""
    at = df.groupBy(key).agg(F.max((F.col(side) == 0).cast("int")).alias("a"), F.max((F.col(side) == 1).cast("int")).alias("b"))
    sums = at.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("n_a", F.col("a")), ("n_b", F.col("b")), ("n_both", F.col("a") * F.col("b")), ("n_any", F.greatest("a", "b")))])
    return sums.withColumn("jaccard", F.when(F.col("n_any") == 0, 1.0).otherwise(F.col("n_both") / F.col("n_any")))


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def union_size(n_a: int, n_b: int, n_both: int) -> int:
    """By inclusion and exclusion."""
    return n_a + n_b - n_both


def collisions(df: DataFrame, key: str, h: str) -> DataFrame:
    """(n_keys, n_hashes, n_colliding): distinct keys, distinct hashes, and keys that share one."""
    per = df.select(key, h).distinct().groupBy(h).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.count(F.lit(1)).alias("n_hashes"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_colliding"))
