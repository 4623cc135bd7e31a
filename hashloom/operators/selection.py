"""Exact order statistics and percentiles, without a group's values in one task.

A mergeable quantile sketch brackets each wanted rank by two values that occur; one exact
pass counts what is below the bracket and keeps what is inside.  That is a small share of
the rows, but for ties; a bracket of one value is the answer, and others go on with what
was kept, until no bracket holds more than ``FEW`` rows, which are sorted.  A sketch that
is off costs a round, not exactness: a rank outside its bracket is sought on that side.

Defined cases: nulls don't count; NaN is greater than all else, as in Spark; a group
without values gives no row; an empty frame gives none; a group of null is a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.sources.shared import forget, written

FEW, MARKS, ACCURACY = 10_000, 256, 20_000


def _with(rows: DataFrame, lookup: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows with each row of ``lookup`` of their group; null is a group."""
    names = {c: f"__of{i}" for i, c in enumerate(by)}
    other = lookup.withColumnsRenamed(names)
    if not by:
        return rows.crossJoin(F.broadcast(other))  # a row for each rank
    return rows.join(other, reduce(and_, [rows[c].eqNullSafe(other[n]) for c, n in names.items()])).drop(*names.values())


def _inner(by: Sequence[str]) -> dict[str, str]:
    """Names that clash with none of those used here."""
    return {c: f"__by{i}" for i, c in enumerate(by)}


def nth(rows: DataFrame, value: str, ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, rank, value): the value of each rank, from 0, among its group's in order.
    ``ranks`` has (by, rank); ranks that a group doesn't have give no row."""
    own = _inner(by)
    named = lambda df, *more: df.select(*[F.col(c).alias(n) for c, n in own.items()], *more)
    found = _nth(named(rows, F.col(value).alias("__v")), named(ranks, "rank"), list(own.values()))
    return found.select(*[F.col(n).alias(c) for c, n in own.items()], "rank", F.col("__v").alias(value))


def _nth(rows: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    # Each rank is a search of its own: ``place`` is its rank among the rows still there.
    live = _with(rows.filter("__v is not null"), ranks.select(*by, "rank", F.col("rank").alias("place")), by)
    key, found = [*by, "rank"], []
    largest = rows.filter("__v is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    while (largest or 0) > FEW:
        # The sketch's percentiles are values that occur; the rank's is between two of them.
        marks = F.percentile_approx("__v", [k / MARKS for k in range(MARKS + 1)], ACCURACY)
        sizes = live.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("at"), marks.alias("marks")).filter("at >= 0 and at < n")
        mark = lambda c: F.element_at("marks", F.least(F.greatest(c, F.lit(0)), F.lit(MARKS)).cast("int") + 1)
        near = F.col("at") * MARKS / F.col("n")
        sketch = written(sizes.select(*key, mark(F.floor(near) - 1).alias("lo"), mark(F.ceil(near) + 1).alias("hi")), "marks")
        told = _with(live, sketch.withColumnRenamed("rank", "__rank"), by).filter("rank = __rank").drop("__rank")
        v = F.col("__v")
        counts = told.groupBy(*key).agg(F.max("place").alias("place"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(v < F.col("lo")).alias("below"), F.count_if((v >= F.col("lo")) & (v <= F.col("hi"))).alias("inside"), F.count_if(v > F.col("hi")).alias("above"))
        before = F.when(F.col("place") < F.col("below"), 0).when(F.col("place") < F.col("below") + F.col("inside"), F.col("below")).otherwise(F.col("below") + F.col("inside"))
        side = F.when(F.col("place") < F.col("below"), -1).when(F.col("place") < F.col("below") + F.col("inside"), 0).otherwise(1)
        kept = F.when(F.col("side") < 0, F.col("below")).when(F.col("side") > 0, F.col("above")).otherwise(F.col("inside"))
        state = written(counts.withColumns({"side": side, "next": F.col("place") - before}).withColumn("kept", kept), "state")
        one = (F.col("side") == 0) & (F.col("lo") == F.col("hi"))
        found.append(state.filter(one).select(*key, F.col("lo").alias("__v")))
        more = state.filter(~one).select(*by, F.col("rank").alias("__rank"), "lo", "hi", "side", "next")
        inside = F.when(F.col("side") < 0, v < F.col("lo")).when(F.col("side") > 0, v > F.col("hi")).otherwise((v >= F.col("lo")) & (v <= F.col("hi")))
        old, live = live, written(_with(live, more, by).filter((F.col("rank") == F.col("__rank")) & inside).select(*by, "rank", F.col("next").alias("place"), "__v"), "live")
        if len(found) > 1:
            forget(old)
        most = state.filter(~one).agg(F.max("kept")).first()[0]
        if most is None or most <= FEW:
            break
    at = F.row_number().over(Window.partitionBy(*key).orderBy("__v")) - 1
    found.append(live.withColumn("__at", at).filter(F.col("__at") == F.col("place")).select(*key, "__v"))
    return reduce(DataFrame.unionByName, found)


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, share, value): percentiles with linear interpolation between neighbours."""
    if not all(0 <= p <= 1 for p in shares):
        raise ValueError("shares are from 0 to 1")
    own = _inner(by)
    rows = rows.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(value).cast("double").alias("__value"))
    names, by, out, value = list(by), list(own.values()), value, "__value"
    n = written(rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 0"), "sizes")
    exact = F.col("share") * (F.col("__n") - 1)
    wanted = n.select(*by, "__n", F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")).withColumns({"low": F.floor(exact).cast("long"), "high": F.ceil(exact).cast("long"), "part": exact - F.floor(exact)})
    wanted = written(wanted.drop("__n"), "wanted")
    ranks = wanted.select(*by, F.explode(F.array("low", "high")).alias("rank")).distinct()
    got = written(nth(rows, value, ranks, by), "ranks")
    at = lambda name: _with(wanted if name == "low" else both, got.select(*by, F.col("rank").alias("__r"), F.col(value).alias(f"__{name}")), by).filter(F.col(name) == F.col("__r")).drop("__r")
    both = at("low")
    both = at("high")
    between = F.when(F.col("part") == 0, F.col("__low")).otherwise(F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("part"))
    return both.select(*[F.col(n).alias(c) for c, n in zip(names, by, strict=True)], "share", between.alias(out))


def median(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value): the middle value, or the mean of the middle two."""
    return percentiles(rows, value, [0.5], by).drop("share")
