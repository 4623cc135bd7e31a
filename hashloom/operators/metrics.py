"""Errors, summaries and limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.operators import selection, states


def relative_error(est: Column, true: Column) -> Column:
    return (est - true.cast("double")) / true.cast("double")


def jaccard_error(est: Column, true: Column) -> Column:
    """Relative to 1.0 where the true similarity is 0."""
    return (est - true) / F.when(true > 0, true).otherwise(1.0)


def mean_relative_error(est: DataFrame, freq: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted over distinct keys."""
    return est.join(freq, key).groupBy(*by).agg(F.avg(relative_error(F.col("est"), F.col("freq"))).alias("relerr"))


def summary(rows: DataFrame, value: str = "relerr", by: str = "function") -> DataFrame:
    """Mean, population deviation and sixth standardized moment (a deviation of 0 divides
    by 1) of each function, in the order of names; one pass, by mergeable moments."""
    moments = states.Moments(6)
    state = states.build(rows.select(by, F.col(value).cast("double").alias(value)), moments, value, [by])
    of = lambda f: states.measure(F.col("state"), f, moments)
    sd = of(lambda s: float((s[2] / s[0]) ** 0.5))
    return state.select(by, of(lambda s: float(s[1])).alias("mean"), sd.alias("sd"), of(lambda s: moments.standardized(s, 6)).alias("m6")).orderBy(by)


def limits(rows: DataFrame, value: str = "relerr", pad: float = 0.05, exclude: Sequence[str] = (), by: str = "function", percentiles: tuple[float, float] | None = None) -> DataFrame:
    """(lo, hi): least and greatest value (or percentiles), padded.  Functions to exclude
    are left out unless nothing else is there."""
    kept = rows.withColumn("__in", ~F.col(by).isin(list(exclude)) if exclude else F.lit(True))
    some = F.max(F.col("__in").cast("int"))
    pick = lambda f: F.coalesce(F.when(some == 1, f(F.when(F.col("__in"), F.col(value)))), f(F.col(value)))
    if percentiles is None:
        span = kept.agg(pick(F.min).alias("lo"), pick(F.max).alias("hi"))
    else:
        some_in = kept.filter("__in").filter(F.col(value).isNotNull()).limit(1).count() > 0
        found = selection.percentiles(kept.filter("__in") if some_in else kept, value, sorted(set(percentiles)))
        of = lambda p: F.max(F.when(F.col("share") == p, F.col(value)))
        span = found.agg(of(percentiles[0]).alias("lo"), of(percentiles[1]).alias("hi"))
    width = F.greatest(F.lit(1e-12), F.col("hi") - F.col("lo")) * pad
    return span.select((F.col("lo") - width).alias("lo"), (F.col("hi") + width).alias("hi"))


def throughput(rows: DataFrame, by: Sequence[str] = ("function",)) -> DataFrame:
    """Median seconds of the rounds of each function, M hashes per second, ns per hash, and
    the xor of the checksums; rows have sec, n, loops and checksum."""
    job = [*by, "n", "loops"]
    middle = selection.median(rows, "sec", job).withColumnsRenamed({c: f"__{c}" for c in job})
    sums = rows.groupBy(*job).agg(F.bit_xor("checksum").alias("checksum"))
    med = sums.join(middle, reduce(and_, [sums[c].eqNullSafe(middle[f"__{c}"]) for c in job])).drop(*[f"__{c}" for c in job])
    total = (F.col("n") * F.col("loops")).cast("double")
    return med.withColumns({"mhash_s": total / F.col("sec") / 1e6, "ns_per_hash": F.col("sec") * 1e9 / total}).orderBy("ns_per_hash", *by)


def checksum(df: DataFrame, h: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.bit_xor(h).alias("checksum"))
