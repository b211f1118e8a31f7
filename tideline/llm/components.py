"""Connected components of an edge table, as joins in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for edges (a, b).

    In each round a node takes the least label of its neighbours, then that node's
    label (pointer jumping), so a chain of n nodes takes about log n rounds.  Rounds
    are written to the shared folder.  Nodes without an edge aren't listed."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        nxt = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "m").alias("m"))
        hop = labels.select(F.col("node").alias("m"), F.col("label").alias("mm"))
        nxt = settle(nxt.join(hop, "m", "left").select("node", F.coalesce(F.least("mm", "m"), F.col("m")).alias("new"), "label"), "labels")
        moved = nxt.where("new <> label").limit(1).count()
        labels = nxt.select("node", F.col("new").alias("label"))
        if not moved:
            return labels
