"""Connected components of an edge table by smallest label, as joins and partial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` for each end of ``edges(a, b)``: the smallest identifier that edges reach.

    Each round takes the smallest label among the neighbours and then that label's own label, so that rounds grow with
    the logarithm of a component's width. Labels are written each round; hubs only cost map-side partial minima.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "label")
        step = cut(labels.union(near).groupBy("id").agg(F.min("label").alias("label")))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = cut(step.join(jump, "label").select("id", F.col("further").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "was"), "id").filter("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels
