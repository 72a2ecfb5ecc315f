"""Ontology (directed acyclic graph) operators over ``dag(child, parent)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.operators.ordered import union_all
from strandframe.session import cut_lineage


def relations(term2term: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child → parents, parent → children) as distinct pair tables."""
    pairs = term2term.select("child", "parent").distinct()
    return pairs, pairs.select("parent", "child")


def closure(dag: DataFrame, max_depth: int = 100, reflexive: bool = True) -> DataFrame:
    """All (ancestor, descendant, distance) paths, every distinct distance.

    The frontier grows towards the roots, where a step has few matches per row;
    each level is written out so that lost executors cost one level only.
    """
    edges = cut_lineage(dag.select("child", "parent").distinct())
    levels = []
    if reflexive:
        terms = edges.select(F.col("child").alias("t")).union(edges.select("parent")).distinct()
        levels.append(terms.select(F.col("t").alias("ancestor"), F.col("t").alias("descendant"), F.lit(0).alias("distance")))
    frontier = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance"))
    for depth in range(1, max_depth + 1):
        levels.append(frontier)
        frontier = cut_lineage(
            frontier.join(edges.withColumnRenamed("child", "ancestor"), "ancestor")
            .select(F.col("parent").alias("ancestor"), "descendant", F.lit(depth + 1).alias("distance"))
            .distinct()
        )
        if frontier.isEmpty():
            return union_all(levels)
    raise ValueError(f"paths longer than {max_depth}: the graph has a cycle or needs a larger max_depth")


def ancestors(paths: DataFrame, terms: DataFrame) -> DataFrame:
    """Ancestors of the given terms (themselves included at distance 0)."""
    return paths.join(terms.select(F.col("term").alias("descendant")), "descendant", "left_semi").select("descendant", "ancestor").distinct()


def descendants(paths: DataFrame, terms: DataFrame) -> DataFrame:
    """Proper descendants of the given terms."""
    below = paths.filter("distance <> 0")
    return below.join(terms.select(F.col("term").alias("ancestor")), "ancestor", "left_semi").select("ancestor", "descendant").distinct()


def expand_term(paths: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms related to each given term in either direction."""
    up = ancestors(paths, terms).select(F.col("descendant").alias("term"), F.col("ancestor").alias("related"))
    down = descendants(paths, terms).select(F.col("ancestor").alias("term"), F.col("descendant").alias("related"))
    return up.union(down).distinct()


def levels(paths: DataFrame, root: str) -> DataFrame:
    """Distances of each term from the root: all, largest and smallest."""
    return (
        paths.filter(F.col("ancestor") == root)
        .groupBy(F.col("descendant").alias("term"))
        .agg(F.sort_array(F.collect_set("distance")).alias("distances"),
             F.max("distance").alias("max_level"), F.min("distance").alias("min_level"))
    )


def propagate(annots: DataFrame, paths: DataFrame) -> DataFrame:
    """Members of each term, its descendants' members included: (term, member)."""
    pairs = paths.select("ancestor", F.col("descendant").alias("term")).distinct()
    return annots.select("term", "member").distinct().join(pairs, "term").select(F.col("ancestor").alias("term"), "member").distinct()


def informative(members: DataFrame, dag: DataFrame, n: int) -> DataFrame:
    """Terms with at least ``n`` members and no child that also has as many."""
    big = members.groupBy("term").agg(F.count("*").alias("n_members")).filter(F.col("n_members") >= n)
    big_children = dag.select("child", "parent").distinct().join(big.select(F.col("term").alias("child")), "child", "left_semi")
    return big.join(big_children.select(F.col("parent").alias("term")).distinct(), "term", "left_anti")


def annotate_terms(annots: DataFrame, paths: DataFrame, root_levels: DataFrame, term_dim: DataFrame) -> DataFrame:
    """Members with all ancestor terms, level and category."""
    full = propagate(annots, paths)
    return full.join(root_levels.select("term", "max_level"), "term").join(term_dim.select("term", "category"), "term").select(
        "member", "term", F.col("max_level").alias("level"), "category").distinct()


def filter_levels(annotated: DataFrame, wanted: list[int], categories: list[str]) -> DataFrame:
    """Annotations at the wanted levels and categories."""
    return annotated.filter(F.col("level").isin(*wanted) & F.col("category").isin(*categories)).distinct()


def term_dim(terms: DataFrame) -> DataFrame:
    """Term ↔ id dictionary with descriptions."""
    return terms.select("term", "term_id", "name", "category").distinct()


def terms_of(annots: DataFrame) -> DataFrame:
    """Sorted distinct terms of each member."""
    return annots.groupBy("member").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def pathway_graph(typed_edges: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Projections of a pathway table: pathway list, genes, edges, complex ↔ gene maps."""
    return {
        "pathways": members.select("pathway").distinct(),
        "genes": members.select("gene").distinct(),
        "pathway_genes": members.select("pathway", "gene").distinct(),
        "edges": typed_edges.select("a", "b").distinct(),
        "complex_genes": members.filter(F.col("complex").isNotNull()).select("complex", "gene").distinct(),
    }
