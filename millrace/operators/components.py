"""Connected components of a graph held as a table of edges: smallest-label propagation with label jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import checkpointed, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node of its component) for every node that stands in `edges`.

    Each round a node takes the smallest label among its neighbours and then the label of its label, so rounds
    follow the logarithm of the longest path rather than its length. Labels are written to the shared folder
    after each round; nothing is gathered.
    """
    both = checkpointed(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a)).distinct())
    labels, _ = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "at", "label": "seen"}), F.col("other") == F.col("at")) \
            .groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = labels.withColumnsRenamed({"node": "at", "label": "top"})
        moved, _ = stored(step.join(up, F.col("label") == F.col("at")).select("node", "old", F.least("label", "top").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("old != label").isEmpty():
            return labels
