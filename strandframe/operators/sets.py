"""Set operations, ordering, top-k and simple list utilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.operators.ordered import top_rows


def order_timeline(timeline: DataFrame, week: str = "week", seq_no: str | None = None) -> DataFrame:
    """Events sorted by time; equal times keep their input order when numbered."""
    return timeline.orderBy(*([week, seq_no] if seq_no else [week]))


def order_features(features: DataFrame) -> DataFrame:
    return features.orderBy("seq_id", "start", "end", "name")


def top_terms(chart: DataFrame, n: int, cut: float = 0.05) -> DataFrame:
    """Most populated significant terms of each category."""
    kept = chart.filter(F.col("pvalue") <= cut)
    return top_rows(kept, ["category"], [F.desc("count"), F.col("term")], n)


def top_features(df: DataFrame, n: int, score: str = "score", tie: str = "feature") -> DataFrame:
    """Best features by score, missing scores last."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(tie)).limit(n)


def sort_chart(chart: DataFrame) -> DataFrame:
    return chart.orderBy("category", "term")


def order_by_class_size(samples: DataFrame, cls: str = "cls", sample: str = "sample") -> DataFrame:
    """Samples with the size of their class, smallest class first."""
    sizes = samples.groupBy(cls).agg(F.count("*").alias("class_size"))
    return samples.join(sizes, cls).orderBy("class_size", cls, sample)


def first_match(df: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first row that qualifies."""
    return df.filter(condition).orderBy(order).limit(1)


def intersect_all(dfs: list[DataFrame]) -> DataFrame:
    """Rows common to all inputs."""
    return reduce(DataFrame.intersect, dfs)


def union_distinct(dfs: list[DataFrame]) -> DataFrame:
    """Rows of any input, once each."""
    return reduce(DataFrame.unionByName, dfs).distinct()


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks."""
    return a.subtract(b)


def check_background(items: DataFrame, background: DataFrame, extend: bool = False) -> DataFrame:
    """Background that covers ``items``; without ``extend`` an uncovered item is an error."""
    lost = missing(items, background)
    if extend:
        return background.union(lost)
    if not lost.isEmpty():
        raise ValueError("items outside the background")
    return background


def slim(terms1: DataFrame, terms2: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Common terms with category and description."""
    return terms1.select("term").intersect(terms2.select("term")).join(descriptions, "term")


def in_list(ids: DataFrame, wanted: DataFrame, on: str = "id") -> DataFrame:
    """Ids found in a fixed list."""
    return ids.join(wanted, on, "left_semi").distinct()


def multi_intersect(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Items shared by all sets of each group: ``groups(group_id, set_id)``."""
    need = groups.distinct().groupBy("group_id").agg(F.count("*").alias("_need"))
    got = sets.distinct().join(groups.distinct(), "set_id").groupBy("group_id", "item").agg(F.count("*").alias("_got"))
    return got.join(need, "group_id").filter("_got = _need").select("group_id", "item")
