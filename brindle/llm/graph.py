"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.store import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node, label for each node of ``edges`` (a, b): label is the smallest node reachable.

    Each round takes the least label of the neighbours, then that label's own label, so paths
    shorten by doubling; a round is a few joins and one checkpoint, and rounds end when no
    label changes. Null ends and loops are ignored; an empty table has no nodes.
    """
    edges = edges.filter("a <> b").select("a", "b").distinct()
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        # The labels' own labels: a row for each label, so that a large component isn't one task's work.
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("up"))
        heads = labels.select("label").distinct().join(up, F.col("label") == F.col("n")).select("label", "up")
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), "least").join(heads.withColumnRenamed("label", "old"), "old", "left")
        step = checkpointed(lower.select("node", F.least("old", "least", "up").alias("label"), "old"))
        if not step.filter("label <> old").limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")
