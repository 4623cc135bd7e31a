"""Connected components of links between documents, without a collected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.shared import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that label,
    so long chains shrink by half or more at a time.  Rounds are cut by written tables."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    edges = written(both.union(both.select("other", "node")).distinct(), "edges")
    label = written(edges.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = (
            edges.join(label.select(F.col("node").alias("other"), "component"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("m"))
        )
        lower = label.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "m").alias("now"))
        jump = lower.select(F.col("node").alias("now"), F.col("now").alias("after"))
        new = written(lower.join(jump, "now").select("node", "before", F.least("now", "after").alias("component")), "labels")
        forget(label)
        label = new.select("node", "component")
        if not new.filter("before <> component").limit(1).count():
            forget(edges)
            return label
