"""URL rules and listed hosts, looked up in Bloom filter cascades.

A cascade answers exact membership for the keys of one universe, here every key that any url of
the corpus can ask for. Level 1 holds the listed keys; level 2 the keys of the universe that level
1 takes for listed by mistake; level 3 the listed keys that level 2 takes for those; and so on
until a level makes no mistake. A key is followed down to the first level that does not hold it:
an odd one means not listed, an even one means listed. No url is ever joined with a list.

A rule is the string host + path; the keys of a url are the host suffixes that begin at a label,
each with the path prefixes of the lengths that rules have.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandframe.llm.rows import pack, unpack
from strandframe.session import cut_lineage

#: Share of the keys asked that a level after the first takes for its own.
FALSE_POSITIVES = 0.05
#: Most bits of one level; a longer list is cut into shards, each looked up in a pass of its own.
MAX_BITS = 1 << 28
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Shape:
    """What keys can be listed at all: the most labels of a host and the lengths of paths."""

    labels: int
    path_lengths: tuple[int, ...]


def shape_of(rules: DataFrame) -> Shape:
    """Of ``rules`` (``host``, ``path``). A length list of over 64 entries becomes all lengths up to the longest."""
    row = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("longest")).first()
    if row["labels"] is None:
        return Shape(0, ())
    found = sorted(r[0] for r in rules.select(F.length("path")).distinct().limit(65).collect())
    return Shape(row["labels"], tuple(found) if len(found) <= 64 else tuple(range(row["longest"] + 1)))


def keys_of(host: Column, path: Column, shape: Shape) -> Column:
    """Keys of a url as array<struct<host, path>>, longest first (of equal length, longer host first).

    A suffix with more labels than any listed host, and a prefix of a length that no listed path
    has, cannot be listed and is left out.
    """
    labels = F.split(host, r"\.")
    take = F.least(F.size(labels), F.lit(shape.labels))
    counts = F.when((F.length(host) > 0) & (take > 0), F.sequence(F.lit(1), take)).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(counts, lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    lengths = F.array(*map(F.lit, shape.path_lengths)) if shape.path_lengths else F.array().cast("array<int>")
    fitting = F.filter(lengths, lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.struct(
        (-F.length(h) - n).alias("rank"), (-F.length(h)).alias("rank2"), h.alias("host"), path.substr(F.lit(1), n).alias("path")))))
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p["host"].alias("host"), p["path"].alias("path")))


def key_hash(host: Column, path: Column) -> Column:
    """Two 64-bit hashes that stand for a key everywhere below."""
    return F.struct(F.xxhash64(host, path).alias("h1"), F.xxhash64(F.lit(7), path, host).alias("h2"))


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint64 words
    hashes: int

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.bits) * 64)
        out = np.ones(len(h1), bool)
        for k in range(self.hashes):
            at = (h1 + np.uint64(k) * h2) % size
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _mixed(keys: DataFrame, seed: int) -> DataFrame:
    """Hashes of a level, other ones than those of the level before."""
    return keys.select("h1", "h2", F.xxhash64("h1", "h2", F.lit(seed)).alias("a"), F.xxhash64("h2", F.lit(seed), "h1").alias("b"))


def bits_for(n: int, rate: float) -> float:
    return -n * math.log(rate) / math.log(2) ** 2


def first_rate(n_inside: int, n_universe: int) -> float:
    """Level 1 errs on about half as many keys as it holds, however large the universe is."""
    return min(0.5, max(n_inside / max(n_universe, 1) / 2, 1e-9))


def build_level(keys: DataFrame, n: int, rate: float) -> Level:
    """A filter over ``keys`` (``a``, ``b``): bits set by a distributed OR per word, at most MAX_BITS / 64 words."""
    words = max(1, math.ceil(bits_for(n, rate) / 64))
    if words * 64 > MAX_BITS:
        raise ValueError(f"{n} keys need more than {MAX_BITS} bits: use more shards")
    hashes = max(1, round(words * 64 / max(n, 1) * math.log(2))) if n else 1
    hashes = min(hashes, 16)

    def marks(batches):
        for rows in batches:
            a, b = (rows[c].to_numpy().view(np.uint64) for c in "ab")
            every = np.concatenate([(a + np.uint64(k) * b) % np.uint64(words * 64) for k in range(hashes)])
            bits = np.zeros(words, np.uint64)
            np.bitwise_or.at(bits, (every >> np.uint64(6)).astype(np.int64), np.uint64(1) << (every & np.uint64(63)))
            at = np.flatnonzero(bits)
            yield pd.DataFrame({"word": at, "bits": bits[at].view(np.int64)})

    found = keys.select("a", "b").mapInPandas(marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(words, np.uint64)
    for r in found.toLocalIterator():
        bits[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return Level(bits, hashes)


def build_cascade(inside: DataFrame, universe: DataFrame, rate: float) -> list[Level]:
    """Levels for the listed keys ``inside`` over ``universe`` (both distinct ``h1``, ``h2``); ``rate`` is level 1's.

    ``universe`` may hold listed keys; they are taken out where level 1 finds them.
    """
    spark = inside.sparkSession
    own, other = cut_lineage(inside), None
    levels: list[Level] = []
    while n := own.count():
        seed = len(levels)
        level = build_level(_mixed(own, seed), n, FALSE_POSITIVES if seed else rate)
        levels.append(level)
        sent = spark.sparkContext.broadcast(level)  # at most MAX_BITS

        def caught(batches):
            for rows in batches:
                a, b = (rows[c].to_numpy().view(np.uint64) for c in "ab")
                yield rows.loc[sent.value.holds(a, b), ["h1", "h2"]]

        asked = universe if other is None else other
        wrong = _mixed(asked, seed).mapInPandas(caught, "h1 long, h2 long")
        if other is None:
            wrong = wrong.join(inside, ["h1", "h2"], "left_anti")
        own, other = cut_lineage(wrong), own
    return levels


class Cascade:
    """One or more shards of levels; shard = high bits of the key hash."""

    def __init__(self, shards: list[list[Level]]):
        self.shards = shards

    @staticmethod
    def build(rules: DataFrame, universe: DataFrame) -> Cascade:
        """For ``rules`` (``host``, ``path``) over ``universe`` (distinct ``h1``, ``h2``)."""
        inside = cut_lineage(rules.select(key_hash(F.col("host"), F.col("path")).alias("k")).select("k.*").distinct())
        held = inside.count()
        rate = first_rate(held, universe.count())
        n = max(1, math.ceil(bits_for(held, rate) / (MAX_BITS / 2)))  # by half, as shards differ in size
        part = lambda df, k: df.filter(F.pmod("h2", F.lit(n)) == k) if n > 1 else df
        return Cascade([build_cascade(part(inside, k), part(universe, k), rate) for k in range(n)])


def follow(levels: list[Level], mixed: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Membership of ``n`` keys of the universe, given their two hashes at each level."""
    out, on = np.zeros(n, bool), np.arange(n)
    for k, level in enumerate(levels):
        held = level.holds(mixed[k][0][on], mixed[k][1][on])
        out[on[~held]] = k % 2 == 1
        on = on[held]
    out[on] = len(levels) % 2 == 1  # the last level makes no mistake: what it holds is its own
    return out


def _looker(sent, shard: int):
    """Function from one row's flat array, for each key its shard and two hashes a level, to membership."""
    def look(column: pd.Series) -> pd.Series:
        levels = sent.value
        width = 1 + 2 * len(levels)
        sizes = column.map(len).to_numpy()
        every = np.concatenate([np.asarray(x, np.int64) for x in column]) if sizes.sum() else np.empty(0, np.int64)
        rows = every.reshape(-1, width)
        mixed = [(rows[:, 1 + 2 * k].astype(np.uint64), rows[:, 2 + 2 * k].astype(np.uint64)) for k in range(len(levels))]
        yes = follow(levels, mixed, len(rows)) & (rows[:, 0] == shard)
        return pd.Series(np.split(yes, np.cumsum(sizes // width)[:-1]))

    return look


def with_membership(df: DataFrame, keys: str, cascade: Cascade, name: str) -> DataFrame:
    """``df`` with ``name``: array<boolean>, whether each key of array<struct<host, path>> ``keys`` is listed.

    A pass per shard; its levels are broadcast, at most MAX_BITS each and geometrically shrinking.
    """
    spark: SparkSession = df.sparkSession
    shards = cascade.shards
    out = df.withColumn(name, F.transform(keys, lambda k: F.lit(False)))
    for s, levels in enumerate(shards):
        if not levels:
            continue
        sent = spark.sparkContext.broadcast(levels)
        hashes = F.transform(keys, lambda k: key_hash(k["host"], k["path"]))
        # per level, and per key, the two hashes of that level; flat arrays cross to Python
        seeds = range(len(levels))
        flat = F.flatten(F.transform(hashes, lambda h: F.array(
            F.pmod(h["h2"], F.lit(len(shards))),
            *[x for k in seeds for x in (F.xxhash64(h["h1"], h["h2"], F.lit(k)), F.xxhash64(h["h2"], F.lit(k), h["h1"]))])))
        udf = F.pandas_udf(_looker(sent, s), "array<boolean>").asNondeterministic()
        out = out.withColumn("_now", udf(flat)).withColumn(name, F.zip_with(name, "_now", lambda a, b: a | b)).drop("_now")
        if s + 1 < len(shards):
            out = cut_lineage(out)
    return out


def judge_urls(
    urls: DataFrame, rules: DataFrame, listed_hosts: DataFrame, url_col: str = "url",
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``listed_host``.

    ``rules`` has ``verdict`` (allow or block), ``host``, ``path``; ``listed_hosts`` has ``host``, each
    of which stands for itself and its subdomains. The longest fitting rule gives the verdict (of
    equal ones the one with the longer host, then allow); without one a url is blocked when its host
    is listed (``listed_host``: the longest). Hosts are compared lower-cased A-Z; a null url, and one
    without ``://``, has an empty host and path and fits nothing. Empty lists fit nothing. Columns
    named like the new ones are replaced; repeated rows stay.
    """
    rules, hosts = cut_lineage(rules), cut_lineage(listed_hosts.select("host", F.lit("").alias("path")))
    by_rule, by_host = shape_of(rules), shape_of(hosts)
    parts = pack(urls, host=host_of(F.col(url_col)), path=path_of(F.col(url_col)))

    def asked(shape: Shape) -> Column:
        return keys_of(F.col("host"), F.col("path"), shape)

    def universe(shape: Shape) -> DataFrame:
        key = F.explode(asked(shape)).alias("k")
        return cut_lineage(parts.select("host", "path").distinct().select(key).select(
            key_hash(F.col("k.host"), F.col("k.path")).alias("h")).select("h.*").distinct())

    rule_keys, host_keys = universe(by_rule), universe(by_host)
    out = parts.withColumn("keys", asked(by_rule)).withColumn("hosts", asked(by_host))
    for verdict in ("allow", "block"):
        out = with_membership(out, "keys", Cascade.build(rules.filter(F.col("verdict") == verdict), rule_keys), verdict)
    out = with_membership(out, "hosts", Cascade.build(hosts, host_keys), "listed")

    def first(keys: str, *flags: str) -> Column:
        zipped = F.arrays_zip(F.col(keys).alias("k"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(flags)])
        hit = lambda x: x["f0"] | x["f1"] if len(flags) > 1 else x["f0"]
        return F.get(F.filter(zipped, hit), F.lit(0))

    out = out.withColumn("hit", first("keys", "allow", "block")).withColumn("name", first("hosts", "listed"))
    rule = F.col("hit")
    verdict = (F.when(rule.isNotNull(), F.when(rule["f0"], F.lit("allow")).otherwise(F.lit("block")))
               .when(F.col("name").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return unpack(out, urls.columns, host=F.col("host"), path=F.col("path"), rule=F.concat(rule["k"]["host"], rule["k"]["path"]),
                  verdict=verdict, listed_host=F.col("name.k.host"))
