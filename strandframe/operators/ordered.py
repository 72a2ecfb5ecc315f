"""Ordered per-key scans that do not need a whole key in one task.

A key may hold a large share of all rows. Rows are therefore scanned in chunks
of the ordering value; one summary row per (key, chunk) carries the state over
chunk borders. ``span`` is the width of a chunk in units of the ordering column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.session import cut_lineage, maybe_broadcast

# kind: (value of the row itself counts, scan runs from the end)
_KINDS = {
    "last": (True, False), "last_before": (False, False), "next": (True, True), "next_after": (False, True),
    "sum": (True, False), "max": (True, False), "max_before": (False, False),
}


def exact_ranks(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with each row's place from 1 within its keys and, in ``total``, the number of rows of its keys.

    Rows are cut into ranges of (keys, order) of about equal size, so a key of any size is many tasks and equal values
    are parted by what follows in ``order``, which should be unique within a key. A row's place is that within its
    range plus the rows of its keys in the ranges before. Null keys count as one key.
    """
    conf = df.sparkSession
    pieces = max(int(conf.conf.get("spark.sql.shuffle.partitions")), 2 * conf.sparkContext.defaultParallelism)
    # written once, as a second run might draw other range borders
    ranged = cut_lineage(df.repartitionByRange(pieces, *keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))  # at most keys + ranges rows
    w = Window.partitionBy(*keys)
    before = cut_lineage(sizes.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_from"),
        (F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_total")))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_range") == F.col("_from"))
    out = placed.join(maybe_broadcast(before), same)
    added = [F.col("_total").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_before") + F.col("_place")).alias(name), *added)


def _over(kind: str, keys: list, order: str, value: Column, own: bool | None = None) -> Column:
    """Window for a kind. Every frame starts at the unbounded side and grows row by row;
    looking ahead is looking back in descending order, which keeps the scan linear."""
    own_row, backwards = _KINDS[kind]
    own_row = own_row if own is None else own
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc() if backwards else F.col(order))
    return _agg(kind, value).over(w.rowsBetween(Window.unboundedPreceding, 0 if own_row else -1))


def _agg(kind: str, value: Column) -> Column:
    if kind in ("sum", "max", "max_before"):
        return F.sum(value) if kind == "sum" else F.max(value)
    return F.last(value, ignorenulls=True)


def _merge(kind: str, inside: Column, outside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(inside, F.lit(0)) + F.coalesce(outside, F.lit(0))
    if kind.startswith("max"):
        return F.greatest(inside, outside)
    return F.coalesce(inside, outside)


def ordered_scan(df: DataFrame, keys: list[str], order: str, specs: list[tuple[str, str, Column]],
                 span: float | None = None) -> DataFrame:
    """Add one column per ``(name, kind, value)``.

    Kinds: ``last``/``last_before`` (latest non-null value up to / strictly before
    the row), ``next``/``next_after``, ``sum`` (running sum), ``max``/``max_before``.
    ``order`` must be unique within a key. Without ``span`` a plain window is used;
    that form is only for groups with a fixed small size.
    """
    if span is None:
        return df.withColumns({n: _over(k, keys, order, v) for n, k, v in specs})

    chunk = F.floor(F.col(order) / F.lit(span)).alias("_chunk")
    valued = df.withColumn("_chunk", chunk).withColumns({f"_v{i}": v for i, (_, _, v) in enumerate(specs)})

    summaries = []
    for i, (_, kind, _) in enumerate(specs):
        v = F.col(f"_v{i}")
        if kind.startswith("last"):
            s = F.max_by(v, F.when(v.isNotNull(), F.col(order)))
        elif kind.startswith("next"):
            s = F.min_by(v, F.when(v.isNotNull(), F.col(order)))
        else:
            s = F.sum(v) if kind == "sum" else F.max(v)
        summaries.append(s.alias(f"_s{i}"))
    carried = valued.groupBy(*keys, "_chunk").agg(*summaries)
    carried = carried.select(
        *keys, "_chunk",
        *[_over(kind, keys, "_chunk", F.col(f"_s{i}"), own=False).alias(f"_c{i}") for i, (_, kind, _) in enumerate(specs)])
    scanned = valued.withColumns(
        {f"_i{i}": _over(k, [*keys, "_chunk"], order, F.col(f"_v{i}")) for i, (_, k, _) in enumerate(specs)})
    joined = scanned.join(carried, [*keys, "_chunk"])
    return joined.select(
        *[c for c in df.columns if c not in {n for n, _, _ in specs}],
        *[_merge(k, F.col(f"_i{i}"), F.col(f"_c{i}")).alias(n) for i, (n, k, _) in enumerate(specs)],
    )


def value_span(df: DataFrame, column: str, parts: int = 256) -> float:
    """Chunk width that cuts the range of a real column into about ``parts`` chunks."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or hi == lo:
        return 1.0
    return float(hi - lo) / parts


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key; Spark trims every map task to ``k`` rows per key first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_row(df: DataFrame, keys: list[str], score: Column, carry: list[str], largest: bool = True) -> DataFrame:
    """One row per key with the extreme score, by partial aggregation (ties: first in column order)."""
    payload = F.struct(*carry)
    if largest:
        best = F.max(F.struct(score.alias("_score"), payload.alias("_row")))
    else:
        best = F.min(F.struct(score.alias("_score"), payload.alias("_row")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best._row.*")


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
