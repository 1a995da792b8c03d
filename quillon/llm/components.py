"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise

#: A graph of at most so many edges (two ids each, so a few MB) is one task's, and its rounds shuffle nothing.
ONE_TASK_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) to (node, label) for every node of an edge; label is the smallest node it reaches.

    Each round takes the smallest label among a node and its neighbours and then that label's own label, so the rounds
    are about the logarithm of a component's width. Every round's table is written to the shared folder, and the loop
    ends when no label changes. Self-loops and repeated edges are harmless; no edges give an empty table.
    """
    small = edges.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES

    def placed(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if small else df

    turned = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges_both_ways = materialise(placed(edges).select(turned).distinct(), "edges")
    both = placed(edges_both_ways)
    at = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        labels = placed(at).select("node", "label")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialise(moved.join(ahead, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = after.where("was <> label").limit(1).count()
        discard(at)
        at = after
        if not changed:
            discard(edges_both_ways)
            return at.select("node", "label")
