"""Sketches over streams: windowed Count-Min counters and one-permutation minima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.u64 import fast_range32
from hashloom.operators.sketches import SATURATED, RowHash, _cells


def count_min_windows(stream: DataFrame, ts: str, rows: Sequence[tuple[str, RowHash | None]], width: int, window: str, late: str) -> DataFrame:
    """(start, row, col, cnt) of each tumbling window; in append mode, events later than
    ``late`` are dropped."""
    cells = stream.withWatermark(ts, late).select(ts, F.explode(_cells(stream, rows, width)).alias("c"))
    sums = cells.groupBy(F.window(ts, window).alias("w"), "c.row", "c.col").agg(F.least(F.count(F.lit(1)), F.lit(SATURATED)).alias("cnt"))
    return sums.select(F.col("w.start").alias("start"), "row", "col", "cnt")


def oph_windows(stream: DataFrame, ts: str, h: str, m: int, window: str, late: str) -> DataFrame:
    """(start, bin, minhash) of each tumbling window."""
    bins = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), fast_range32(F.col(h), m).alias("bin")).agg(F.min(h).alias("minhash"))
    return bins.select(F.col("w.start").alias("start"), "bin", "minhash")


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a windowed stream over what is there in append mode and reads what it has given:
    a window is sent once, when the watermark has passed its end, and its state is dropped
    then; later events for it are dropped too.  A batch is a folder of its own, written
    over if it runs again, so none counts twice."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("batch")


def settled(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there, keeps its latest result in ``path``, and reads it.
    In ``complete`` mode all windows are in the result and none is dropped, so all state is
    kept: for streams that end.  :func:`appended` is for those that don't."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
