"""Connected components of an edge table by min-label propagation with pointer jumping, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, label), label being the smallest node that can be reached.

    Loops, repeated and reversed edges are harmless; edges with a null end are ignored; no edges give no rows. Every
    round takes the least label among a node's neighbours and then its label's label, so that the number of rounds
    grows with the logarithm of the longest path. A node with very many edges is an aggregation with partial sums and
    the skewed side of a join with one row per key, never a group in one task.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    near_all = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # the nodes stay the same
    hint = F.broadcast if near_all else (lambda df: df)
    while True:
        known = hint(labels)
        near = edges.join(known, edges.b == known.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = near.join(known, "node").select("node", "label", F.least("label", "near").alias("best"))
        hop = hint(labels.select(F.col("node").alias("at"), F.col("label").alias("hop")))
        moved = stored(best.join(hop, best.best == hop.at).select("node", F.col("label").alias("was"), F.least("best", "hop").alias("label")))
        forget(labels)
        labels = moved.select("node", "label")
        if moved.where("was <> label").limit(1).count() == 0:
            forget(edges)
            return labels
