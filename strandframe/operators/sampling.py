"""Draws that do not depend on how the data are partitioned.

Every random choice is the order of a hash of (item, repetition, seed), so a lost task
that is run again makes the same choice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandframe.session import BROADCAST_ROWS, cut_lineage, maybe_broadcast


def hash_key(*cols: str | Column, seed: int = 0) -> Column:
    """Hex digest that orders items at random."""
    return F.md5(F.concat_ws("#", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols], F.lit(str(seed))))


def repeat(df: DataFrame, reps: int, name: str = "rep") -> DataFrame:
    """Every row ``reps`` times. The rows are dealt out first: the copies outweigh that shuffle."""
    spark = df.sparkSession
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(pieces).withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def hash_draw(pool: DataFrame, item: str, reps: int, size: int | float | str, strata: list[str] | None = None,
              seed: int = 0, digits: int = 2) -> DataFrame:
    """Exactly ``size`` items (or that share of each stratum, rounded) per repetition, without replacement.

    ``size`` may name a column that holds the number wanted from a stratum.

    Items are counted by the leading digits of their hash. Buckets above the cut are dropped
    where they arise; ranks are taken within a bucket, so no task sorts a full pool.
    """
    strata = strata or []
    group = [*strata, "rep"]
    named = [size] if isinstance(size, str) else []
    rows = repeat(pool.select(*strata, item, *named), reps).withColumn("_h", hash_key(item, "rep", seed=seed))
    rows = rows.withColumn("_b", F.substring("_h", 1, digits))
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"), *[F.max(c).alias("_size") for c in named])
    w = Window.partitionBy(*group).orderBy("_b")
    total = F.sum("_n").over(Window.partitionBy(*group))
    want = F.col("_size") if named else F.round(total * size) if isinstance(size, float) else F.lit(size)
    cut = (
        counts.withColumns({"_upto": F.sum("_n").over(w), "_all": total, "_want": F.least(want.cast("long"), total)})
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(*group, F.col("_b").alias("_cut"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    # one row per repetition and stratum
    cut_rows = reps * (pool.select(*strata).distinct().count() if strata else 1)
    joined = rows.join(F.broadcast(cut) if cut_rows <= BROADCAST_ROWS else cut, group).filter(F.col("_b") <= F.col("_cut"))
    place = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", item))
    ranked = joined.withColumn("_r", place)
    return ranked.filter((F.col("_b") < F.col("_cut")) | (F.col("_r") <= F.col("_left"))).select(*group, item)


def number_items(items: DataFrame, item: str, seed: int = 0, digits: int = 3) -> DataFrame:
    """Distinct items numbered from 0 in the order of their hashes: (item, _i).

    Items are ranked inside a bucket of leading hash digits; only the 16^digits bucket sizes are summed in one task.
    """
    hashed = cut_lineage(items.select(item).distinct().withColumn("_h", hash_key(item, seed=seed)).withColumn("_b", F.substring("_h", 1, digits)))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", item)) - 1
    return hashed.withColumn("_p", place).join(F.broadcast(before), "_b").select(item, (F.col("_before") + F.col("_p")).alias("_i"))


#: Rounds of the keyed permutation (even), and the two primes its round function reduces by.
ROUNDS, P, Q = 8, 2**31 - 1, 2**31 - 19


def permutation_keys(spark: SparkSession, reps: int, seed: int = 0) -> DataFrame:
    """Four factors below 2^31 for each round of each repetition: (rep, keys)."""
    def key(k: Column) -> Column:
        h = F.md5(F.concat_ws("#", F.col("rep").cast("string"), k.cast("string"), F.lit(str(seed))))
        part = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
        return F.struct(k.alias("k"), *[(v % P if i < 2 else v % Q).alias("abcd"[i]) for i, v in enumerate(part)])
    every = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), key)
    return spark.range(reps).select(F.col("id").cast("int").alias("rep"), every.alias("keys"))


def _grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds ``n`` numbers."""
    high = max(math.isqrt(max(n, 1) - 1) + 1, 1)
    return high, -(-n // high) or 1


def _mixed(right: Column, k: Column) -> Column:
    # sides of the grid are far below P
    return ((right * k["a"] + k["b"]) % P * k["c"] + k["d"]) % Q


def permuted_number(i: Column, keys: Column, n: int) -> Column:
    """Number that a repetition's permutation of 0 to ``n`` - 1 puts in the place of ``i``.

    A Feistel network on the grid of ``high`` x ``low`` numbers, the smallest near-square one that holds ``n``. A number
    that leaves the range goes through the network again; fewer than ``high`` numbers lie outside, so it
    is back after as many passes. Nothing is sorted.
    """
    high, low = _grid(n)

    def turn(x: Column, k: Column) -> Column:
        # the parts change places after each round, and with them the sides of the grid
        top = F.when(k["k"] % 2 == 0, F.lit(high)).otherwise(F.lit(low)).cast("long")
        bottom = F.when(k["k"] % 2 == 0, F.lit(low)).otherwise(F.lit(high)).cast("long")
        right = x % bottom
        return right * top + (F.floor((x - right) / bottom) + _mixed(right, k)) % top

    def through(x: Column) -> Column:
        return F.aggregate(keys, x, turn)

    first = through(i.cast("long"))
    again = F.sequence(F.lit(1), F.lit(high))
    return F.aggregate(again, first, lambda x, _: F.when(x < n, x).otherwise(through(x))) if high * low > n else first


def permute_numbers(numbered: DataFrame, reps: int, n: int, seed: int = 0) -> DataFrame:
    """Rows with a number ``_i`` below ``n``, once for each repetition, numbered by its permutation: (rep, ..., _i).

    The first pass of a number through the network is plain arithmetic; only the few that it leaves
    outside the range walk on (``permuted_number``).
    """
    high, low = _grid(n)
    rest = [c for c in numbered.columns if c != "_i"]
    keys = permutation_keys(numbered.sparkSession, reps, seed)
    rows = repeat(numbered, reps).join(F.broadcast(keys) if reps <= BROADCAST_ROWS else keys, "rep")
    rows = rows.withColumns({"_l": F.expr(f"bigint(_i) div {low}L"), "_r": F.col("_i").cast("long") % F.lit(low).cast("long")})
    for k in range(ROUNDS):
        side = F.lit(low if k % 2 else high).cast("long")
        rows = rows.withColumns({"_l": F.col("_r"), "_r": (F.col("_l") + _mixed(F.col("_r"), F.col("keys")[k])) % side})
    at = F.col("_l") * F.lit(low).cast("long") + F.col("_r")
    if high * low > n:
        at = F.when(at < n, at).otherwise(permuted_number(at, F.col("keys"), n))
    return rows.select("rep", *rest, at.alias("_i"))


def permute_labels(items: DataFrame, item: str, reps: int, seed: int = 0) -> DataFrame:
    """Each repetition maps every item to another one at random: (rep, item, relabelled).

    Items are numbered once; a repetition's keyed permutation turns numbers into numbers row by row, and these
    are looked up by number, so no task sorts or holds a repetition.
    """
    numbered = cut_lineage(number_items(items, item, seed))
    moved = permute_numbers(numbered, reps, numbered.count(), seed)
    names = numbered.select("_i", F.col(item).alias("relabelled"))
    return moved.join(maybe_broadcast(names), "_i").select("rep", item, "relabelled")
