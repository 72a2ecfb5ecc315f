"""Near-duplicates by exact Jaccard similarity of word shingles, screened by fingerprints.

Sets of similarity ``4/5`` or more share one of their first ``n - ceil(4n/5) + 1`` shingles in any
common order of all shingles, so only documents that share such a key are compared (prefix filter).
Shingles that are frequent in a sample come last in the order; that keeps the keys rare and decides nothing.
At the first shared key of two sets, their places in both bound the overlap (position filter).

A pair is discarded unless the sizes allow the similarity, the places do, the sets' SimHash
fingerprints of 128 bits differ in at most ``RADIUS``, and their parities allow it. Before the bits their rows of
the pivot table are held against each other: distances to the same reference fingerprint that differ by more than
``RADIUS`` mean, by the triangle inequality, that the fingerprints do too. Survivors are verified on the whole sets. A parity says for each of ``CELLS`` cells whether it holds an odd number
of the set's shingles. Shared shingles cancel in the exclusive or of two parities, so its set bits are
at most the shingles that only one set has, of which there can be a ninth of both sizes: an exact bound. Fingerprints of sets of similarity 4/5 differ in 19 bits on average (standard deviation 4), those of
unrelated sets in 64 (6). Sets of fewer than ``SMALL`` shingles, whose bits vary more, are not screened.

Equal sets are one node. First the members of each key are held against its least one, which takes
as many pairs as there are rows; then only members of different components are paired, in tiles.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.llm.graph import components
from strandframe.llm.simhash import BUCKET, fingerprint, least_of_groups, pivots, shingle_hashes
from strandframe.session import cut_lineage

#: Words of a shingle.
SIZE = 5
#: Distinct texts, about, whose shingles are counted for the order, and most shingles it keeps apart.
SAMPLE, COMMON = 4096, 50_000
#: Cells of the parity of a set.
CELLS = 512
#: From how many members on a key is crowded, and how many of them one is held against before all are.
CROWD, NEXT = 64, 4
#: Most bits of 128 in which fingerprints of linked sets differ, and the size from which that is asked.
RADIUS, SMALL = 44, 32
#: Reference fingerprints of the pivot table: two hashes for each.
PIVOTS = 8
_REFS = pivots(2 * PIVOTS)


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Different shingle hashes, sorted."""
    return np.unique(shingle_hashes(text or b"", size))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _sets(text: Column, size: int) -> Column:
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, size).view(np.int64) for t in texts], dtype=object)

    return F.pandas_udf(sets, "array<long>").asNondeterministic()(text.cast("binary"))


def common_shingles(texts: DataFrame, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more texts of a sample (sorted, unsigned) and their counts there."""
    every = max(texts.count() // SAMPLE, 1)
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).dropDuplicates(["text"])
    counts = some.select(F.explode(_sets(F.col("text"), size)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    top = counts.filter("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys = top["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy().astype(np.int64)[order]


def signed_prefix(found: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set by (count in the sample, hash)."""
    rank = np.zeros(len(found), np.int64)
    if len(keys) and len(found):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        rank = np.where(keys[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][:prefix_length(len(found))].view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of the shingles, packed into longs."""
    cell = (found * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=CELLS).astype(np.uint8) & 1).view(np.int64)


def marks(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """``id``, ``hash`` of the text, ``node`` (hash of the shingle set), ``n`` (its size), ``f1`` and ``f2`` (fingerprint), ``pivots``, ``parity`` and ``prefix``."""
    sent = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, size))

    def of(rows: pd.Series) -> pd.DataFrame:
        out = []
        for text in rows:
            found = shingle_set(text, size)
            other = found * np.uint64(0x9E3779B97F4A7C15)  # the second half of the bits, from the shingles hashed on
            halves = fingerprint(found), fingerprint(other ^ other >> np.uint64(32))
            bits = [xxhash.xxh64_intdigest(found.tobytes(), 42), *halves]
            out.append((*np.array(bits, np.uint64).view(np.int64).tolist(), len(found), pivot_row(*halves), parity(found), signed_prefix(found, *sent.value)))
        return pd.DataFrame(out, columns=["node", "f1", "f2", "n", "pivots", "parity", "prefix"])

    udf = F.pandas_udf(of, "node long, f1 long, f2 long, n long, pivots long, parity array<long>, prefix array<long>").asNondeterministic()
    return texts.select("id", F.xxhash64("text").alias("hash"), udf(F.col("text").cast("binary")).alias("s")).select("id", "hash", "s.*")


def pivot_row(f1: int, f2: int) -> int:
    """Distances of a fingerprint to ``PIVOTS`` reference fingerprints, a byte each, as a signed long."""
    row = [(f1 ^ int(a)).bit_count() + (f2 ^ int(b)).bit_count() for a, b in zip(_REFS[::2], _REFS[1::2])]
    return int.from_bytes(bytes(row), "big", signed=True)


_FACTS = ["node", "n", "f1", "f2", "pivots", "place"]


def likely(x, y) -> Column:
    """Whether two sets with facts ``x`` and ``y`` at a shared key can have similarity 4/5.

    ``place`` counts the shingles before the key. If the key is the first that both share, they can
    share no more than it and what follows; at a later key a false answer does no harm.
    """
    n, m = x["n"], y["n"]
    sizes = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    places = 9 * F.least(n - x["place"], m - y["place"]) >= 4 * (n + m)
    byte = lambda v, k: F.shiftright(v, 8 * k).bitwiseAND(F.lit(255))
    rows = functools.reduce(lambda a, b: a & b, [F.abs(byte(x["pivots"], k) - byte(y["pivots"], k)) <= RADIUS for k in range(PIVOTS)])
    bits = F.bit_count(x["f1"].bitwiseXOR(y["f1"])) + F.bit_count(x["f2"].bitwiseXOR(y["f2"]))
    return sizes & places & ((F.least(n, m) < SMALL) | (rows & (bits <= RADIUS)))


def sets_of(marked: DataFrame) -> DataFrame:
    """A row for each set: ``node``, ``n``, ``parity`` and the ``hash`` of a text that has it."""
    return cut_lineage(marked.groupBy("node").agg(F.min("n").alias("n"), F.min("parity").alias("parity"), F.min("hash").alias("hash")))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int = SIZE) -> DataFrame:
    """Those of ``pairs`` (nodes ``a``, ``b``) whose sets have similarity 4/5 or more.

    Only the texts of pairs whose parities allow it are moved: their hashes are written first, so
    Spark knows whether they are few enough to be sent to the scan of the texts.
    """
    side = lambda c: nodes.select(F.col("node").alias(c), F.struct("n", "parity").alias(f"_{c}"))
    odd = F.aggregate(F.zip_with("_a.parity", "_b.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    kept = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").filter(9 * odd <= F.col("_a.n") + F.col("_b.n")).select("a", "b"))
    ends = kept.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = cut_lineage(nodes.join(ends, "node", "left_semi").select("node", "hash"))
    met = texts.select("text", F.xxhash64("text").alias("hash")).join(one, "hash").groupBy("node").agg(F.min("text").alias("text"))
    sets = cut_lineage(met.select("node", _sets(F.col("text"), size).alias("set")))
    both = kept.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb") - shared
    return cut_lineage(both.filter(5 * shared >= 4 * total).select("a", "b"))


def between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends are in different components; a node that ``comps`` lacks is one of its own."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def extended(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components after the links ``more`` between nodes; only the components that they touch are looked at."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    drawn = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    over = components(drawn).select(F.col("node").alias("component"), F.col("component").alias("least"))
    new = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti")
    known = comps.select("node", "component").unionByName(new.select("node", F.col("node").alias("component")))
    return cut_lineage(known.join(over, "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def links(marked: DataFrame, texts: DataFrame, size: int = SIZE, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` between different nodes whose closure is that of all pairs of similarity 4/5 or more."""
    nodes = sets_of(marked)
    keys = marked.select("node", "n", "f1", "f2", "pivots", F.posexplode("prefix").alias("place", "key"))
    ends = keys.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("_last"))
    shared = cut_lineage(ends.filter("rep < _last").select("key", "rep"))
    kept = cut_lineage(keys.join(shared, "key").distinct())
    facts = lambda: F.struct(*_FACTS)
    reps = kept.filter("node = rep").select("key", facts().alias("x"))
    stars = kept.filter("node <> rep").select("key", facts().alias("y")).join(reps, "key").filter(likely(F.col("x"), F.col("y")))
    stars = cut_lineage(stars.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    # A set first goes with the least of its keys' least sets. That links a large group but for a few of its
    # members, with a pair for each; what the other keys propose counts only between components that are still apart.
    one = cut_lineage(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    first = verified(one, nodes, texts, size)
    comps = components(first)
    rest = cut_lineage(between(stars.join(one, ["a", "b"], "left_anti"), comps))
    second = verified(rest, nodes, texts, size)
    comps, first = extended(comps, second), first.unionByName(second)
    # What is left are pairs of members without the least one, of components that are still apart. Where
    # a key has many members, one is first held against the next few only, in an order that is new
    # each time, as long as that links some of them.
    others = kept.filter("node <> rep").select("key", *_FACTS)

    def apart_of(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return rows, cut_lineage(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("_a"), F.max("component").alias("_b")).filter(
            "_a < _b").select("key", "m", F.ceil(F.col("m") / F.lit(bucket)).cast("int").alias("tiles")))

    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    rows, apart = apart_of(others)
    crowded = apart.filter(F.col("m") > CROWD)
    if crowded.limit(1).count():
        crowd = cut_lineage(others.join(crowded.select("key"), "key", "left_semi"))
        turn, going = 0, True
        while going:
            rows, apart = apart_of(crowd)
            order = Window.partitionBy("key", "tile").orderBy(F.xxhash64("node", "key", F.lit(turn)), "node")
            x = F.struct("component", *_FACTS)
            following = rows.join(apart, "key").withColumn("tile", tile).select(
                x.alias("x"), F.array(*[F.lead(x, k).over(order) for k in range(1, NEXT + 1)]).alias("y")).select("x", F.explode("y").alias("y"))
            met = following.filter((F.col("x.component") != F.col("y.component")) & likely(F.col("x"), F.col("y")))
            a, b = F.col("x.node"), F.col("y.node")
            tried = cut_lineage(met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
            more = verified(tried, nodes, texts, size)
            found = more.count()
            if found:
                comps, first = extended(comps, more), first.unionByName(more)
            going, turn = found * 16 > tried.count(), turn + 1
        rows, apart = apart_of(others)
    tiled = cut_lineage(rows.join(apart, "key").withColumn("tile", tile))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least("tile", u).alias("lo"), F.greatest("tile", u).alias("hi")))
    dealt = tiled.withColumn("_p", F.explode(pair)).select("key", "_p.lo", "_p.hi", "tile", "component", facts().alias("of"))
    x, y = dealt.alias("x"), dealt.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    once = (F.col("x.tile") == F.col("x.lo")) & (F.col("y.tile") == F.col("y.hi")) & (
        (F.col("x.lo") < F.col("x.hi")) | (F.col("x.of.node") < F.col("y.of.node")))
    met = x.join(y, same & once & (F.col("x.component") != F.col("y.component")) & likely(F.col("x.of"), F.col("y.of")))
    a, b = F.col("x.of.node"), F.col("y.of.node")
    found = cut_lineage(met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    return first.unionByName(verified(found, nodes, texts, size))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One document of each group of near-duplicates, chosen by ``least_of_groups``.

    Documents link when their sets of ``size``-word shingles (all words when fewer) have Jaccard
    similarity 4/5 or more; a group is what links reach. Texts without a word, null ones included, are one
    group. Null and repeated ids lose no group, repeated rows are in one; columns of any name are carried
    as they are. No rows give no rows. A text's shingles are in one task.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = cut_lineage(marks(texts, size))
    found = components(links(marked, texts, size)).select("node", "component")
    grouped = marked.join(found, "node", "left").select("id", "hash", F.coalesce("component", "node").alias("root"))
    return least_of_groups(docs, grouped, id_col, text_col)
