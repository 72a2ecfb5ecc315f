"""Connected components by contraction, for graphs of any shape and any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Least reachable node of each node that has an edge: ``node``, ``component``.

    ``edges`` has ``a`` and ``b`` of one orderable type. In a round every node takes the least label
    among itself and its neighbours, then the label of that label, and edges are drawn again between
    labels, without loops and doubles. Rounds go on until no edge is left, so there is no limit on
    chains; each works on written tables, and a hub is only ever read through partial minima.
    """
    left = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = left.select(F.explode(F.array("a", "b")).alias("node"))
    labels = cut_lineage(ends.distinct().withColumn("component", F.col("node")))
    while left.limit(1).count():
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        least = cut_lineage(both.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("other")).select(
            "node", F.least("node", "other").alias("parent")))
        jump = least.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = cut_lineage(least.join(jump, "parent").select("node", "above"))
        labels = cut_lineage(
            labels.join(parents.select(F.col("node").alias("component"), "above"), "component", "left")
            .select("node", F.coalesce("above", "component").alias("component")))
        moved = left.join(parents.select(F.col("node").alias("a"), F.col("above").alias("a2")), "a").join(
            parents.select(F.col("node").alias("b"), F.col("above").alias("b2")), "b")
        left = cut_lineage(moved.filter("a2 <> b2").select(
            F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    return labels
