"""Undirected networks: degrees, neighbourhoods and groups of a similarity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.session import cut_lineage


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    return edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected pair once, smaller id first."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node of a symmetric network."""
    return edges.select("a", "b").distinct().groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def avg_degree(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean degree of the listed nodes; nodes without edges are ignored."""
    return degree(edges).join(ids.select("id").distinct(), "id", "left_semi").agg(F.avg("degree").alias("avg_degree"))


def degree_hist(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """How many listed nodes have each degree."""
    kept = degree(edges).join(ids.select("id").distinct(), "id", "left_semi")
    return kept.groupBy("degree").agg(F.count("*").alias("n_nodes"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components as (id, component = smallest id).

    Each round takes the smallest label among the neighbours, then follows the label of
    the label, so long chains close in few rounds. The labels are written out between
    rounds; the minimum is pre-aggregated before the shuffle, so a hub is no burden. Rounds go on
    until no label falls any more, however long a chain is.
    """
    both = cut_lineage(symmetric(edges))
    known = nodes_of(both) if nodes is None else nodes.select("id").union(nodes_of(both)).distinct()
    labels = cut_lineage(known.withColumn("component", F.col("id")))
    while True:
        heard = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("_heard"))
        lowered = labels.join(heard, "id", "left").select(
            "id", F.col("component").alias("_old"), F.least("component", F.coalesce("_heard", "component")).alias("component"))
        lowered = cut_lineage(lowered)
        jump = lowered.select(F.col("id").alias("component"), F.col("component").alias("_root"))
        labels = cut_lineage(
            lowered.join(jump, "component", "left").select(
                "id", "_old", F.least("component", F.coalesce("_root", "component")).alias("component")))
        settled = labels.filter("_old <> component").isEmpty()
        labels = labels.select("id", "component")
        if settled:
            return labels


def consensus(similarity: DataFrame, cut: float, nodes: DataFrame | None = None) -> DataFrame:
    """Groups of samples linked by similarity above ``cut``: connected components."""
    return components(similarity.filter(F.col("similarity") > cut).select("a", "b"), nodes)
