"""Connected components of an edge table: least labels, spread and jumped.

Each round a node takes the least label of its neighbours and then the label of
that label, which halves paths. Joins and minima only: no neighbour list is ever
gathered, so that a node with very many edges is an ordinary row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) of all nodes in ``edges`` (a, b)."""
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        met = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("beyond"))
        after = written(met.join(jump, "new").select("node", F.least("new", "beyond").alias("component"), (F.least("new", "beyond") < F.col("component")).alias("moved")), "labels")
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            return labels
