"""Places and running totals in a stable order, without a window over all rows.

Rows are dealt by range and sorted in each partition, and that is written; then a row's
place in its partition is known, and only counts (or sums) of partitions, as many rows as
there are partitions and groups in them, are added up in order and joined back.  No task
sees more than a range of rows, whatever the size of a group: ranges part a group's rows.

Frames given here should be narrow (keys and sizes), as they are written once.

Defined cases: nulls come first; rows that tie in ``order`` take places in no fixed order;
an empty frame gives an empty one; columns named as the result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.sources.shared import written

_LOCAL = (1 << 33) - 1  # monotonically_increasing_id: partition above, row below


def _dealt(df: DataFrame, order: Sequence[str], by: Sequence[str], label: str) -> DataFrame:
    """Adds __part and __at, a row's range and its place there.  Rows alike in all of
    ``order``, even a third of all, are parted by where they were read."""
    keys = [*by, *order, "__tie"]
    rows = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumns({"__part": F.shiftright("__at", 33).cast("int"), "__at": F.col("__at").bitwiseAND(F.lit(_LOCAL).cast("long"))})
    return written(rows, label)


def _joined(rows: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    names = {"__part": "__p", **{c: f"__g{i}" for i, c in enumerate(by)}}
    other = parts.withColumnsRenamed(names)
    if not by:
        other = F.broadcast(other)  # a row for each partition
    on = reduce(and_, [rows[c].eqNullSafe(other[n]) for c, n in names.items()])
    return rows.join(other, on).drop(*names.values())


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), pos: str = "pos", total: str | None = None) -> DataFrame:
    """Adds ``pos``, from 0, in ``order`` among the rows alike in ``by``, and ``total``, the
    number of those rows, if it is named."""
    drop = [c for c in (pos, total) if c in df.columns and c not in (*order, *by)]
    rows = _dealt(df.drop(*drop), order, by, "numbered")
    parts = rows.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by)
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", *by, (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__base"), F.sum("__n").over(group).alias("__total"))
    out = _joined(rows, parts, by).withColumn(pos, F.col("__at") + F.col("__base"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__part", "__at", "__base", "__total")


def running(df: DataFrame, order: Sequence[str], amount: str | Column, by: Sequence[str] = (), before: str = "before") -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows that come earlier in ``order``
    among those alike in ``by``; a null amount counts as 0."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    rows = _dealt(df.withColumn("__amount", F.coalesce(amount, F.lit(0))), order, by, "running")
    earlier = F.sum("__amount").over(Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("__part", *by).agg(F.sum("__amount").alias("__sum"))
    base = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", *by, F.coalesce(base, F.lit(0)).alias("__base"))
    placed = _joined(rows.withColumn("__earlier", F.coalesce(earlier, F.lit(0))), parts, by)
    return placed.withColumn(before, F.col("__earlier") + F.col("__base")).drop("__part", "__at", "__amount", "__earlier", "__base")
