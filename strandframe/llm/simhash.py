"""SimHash near-duplicates, searched with tables of distances to reference fingerprints.

A fingerprint has one bit for each of 64 positions set in more than half of the hashes of its word
shingles. Two fingerprints link when they differ in at most ``max_bits`` bits.

Search: the 64 bits are cut into ``max_bits + 3`` bands, so linked fingerprints agree on at least
three of them; each triple of bands is a bucket key. In a bucket each member has its row of the
pivot table, the Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle inequality
two members whose rows differ anywhere by more than ``max_bits`` cannot link; only the others are
verified bit by bit. A bucket yields a spanning forest of its links, not its pairs. A bucket of
over ``BUCKET`` different fingerprints is cut into tiles, each pair of tiles a task of its own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandframe.llm.graph import components
from strandframe.llm.rows import pack, unpack
from strandframe.session import cut_lineage

#: Reference fingerprints in the distance table.
PIVOTS = 32
#: Most fingerprints that one tile of a bucket holds.
BUCKET = 2048
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, lower-cased A-Z; of all words when fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    solid = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(len(words) - size + 1, 1)
    stop = (ends[size - 1:] if len(words) >= size else ends[-1:]) - 1
    start = np.concatenate(([0], ends[:n - 1]))
    h = xxhash.xxh64_intdigest
    return np.array([h(solid[a:b], 42) for a, b in zip(start.tolist(), stop.tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # of a long text, a part at a time
        bits = np.unpackbits(hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str, size: int, name: str) -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    def prints(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(shingle_hashes(t or b"", size)) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    udf = F.pandas_udf(prints, "long").asNondeterministic()
    return docs.withColumn(name, udf(F.col(text_col).cast("binary")))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers, so every task has the same ones."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k) for k in range(count)], np.uint64)


def distance_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)


def forest(prints: np.ndarray, max_bits: int, left: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``prints``, as index pairs.

    With ``left`` only links between the first ``left`` prints and the rest count. Each member is
    taken up once; it is held against the members not yet reached, by pivot rows, then bit by bit.
    """
    table = distance_table(prints, pivots())
    side = None if left is None else np.arange(len(prints)) < left
    waiting, links = np.ones(len(prints), bool), []
    for root in range(len(prints)):
        if not waiting[root]:
            continue
        waiting[root] = False
        found = [root]
        while found:
            at = found.pop()
            rest = np.flatnonzero(waiting if side is None else waiting & (side != side[at]))
            for p in range(0, PIVOTS, 8):  # eight coordinates at a time: most are out after the first
                rest = rest[np.abs(table[rest, p:p + 8] - table[at, p:p + 8]).max(axis=1, initial=0) <= max_bits]
            near = rest[np.bitwise_count(prints[rest] ^ prints[at]) <= max_bits]
            waiting[near] = False
            links += [(at, int(x)) for x in near]
            found += near.tolist()
    return links


def bands(max_bits: int) -> list[int]:
    n = max_bits + 3
    cuts = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, fp: str = "fp", max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints whose closure is that of all links.

    ``prints`` holds each fingerprint once (signed long).
    """
    masks = [_signed(sum(t)) for t in itertools.combinations(bands(max_bits), 3)]
    keys = F.array(*[
        F.struct(F.lit(k).alias("mask"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    rows = prints.select(F.col(fp).alias("fp"), F.explode(keys).alias("_k")).select("_k.mask", "_k.key", "fp")
    sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    kept = rows.join(sizes, ["mask", "key"]).withColumn("tiles", tiles).withColumn(
        "tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # A member of tile t goes to every pair (t, u): with one tile once, else as often as there are tiles.
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(
        F.least("tile", u).alias("lo"), F.greatest("tile", u).alias("hi")))
    dealt = kept.select("mask", "key", "fp", "tile", F.explode(pair).alias("_p")).select(
        "mask", "key", "_p.lo", "_p.hi", "tile", "fp")

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile", "fp"])
        prints = rows["fp"].to_numpy().view(np.uint64)
        left = None if rows["lo"].iat[0] == rows["hi"].iat[0] else int((rows["tile"] == rows["lo"]).sum())
        found = np.array(forest(prints, max_bits, left), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": prints[found[:, 0]].view(np.int64), "b": prints[found[:, 1]].view(np.int64)})

    return dealt.groupBy("mask", "key", "lo", "hi").applyInPandas(of_group, "a long, b long")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """A row per document: ``id``, ``hash`` (of the text), ``fingerprint`` (16 hex digits) and ``component``.

    ``component`` is the least id reachable over links, the document itself included. A null or
    wordless text has fingerprint zero and links like any other; null ids are passed over (a
    component of nothing else has a null id); repeated rows stay; no rows give no rows. Copies never
    become pairs: links are drawn between different fingerprints.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = cut_lineage(with_fingerprint(texts, "text", size, "fp").select("id", "fp", F.xxhash64("text").alias("hash")))
    comps = fingerprint_components(marked, max_bits)
    return marked.join(comps, "fp").select("id", "hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2,
) -> DataFrame:
    """``docs`` with ``fingerprint`` and ``component_id`` of ``classify``; columns of those names are replaced.

    Rows meet their class by (id, text hash); equal rows have equal classes.
    """
    found = classify(docs, id_col, text_col, size, max_bits).distinct()
    keyed = pack(docs, key=F.col(id_col), text_hash=F.xxhash64(text_col))
    met = keyed.join(found, keyed["key"].eqNullSafe(found["id"]) & (keyed["text_hash"] == found["hash"]), "left")
    return unpack(met, docs.columns, fingerprint=F.col("fingerprint"), component_id=F.col("component"))


def fingerprint_components(marked: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fp``, the ``root`` fingerprint of its component and ``component``, the least reachable id, for each different ``fp`` of ``marked`` (``id``, ``fp``)."""
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(links(prints, "fp", max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    grouped = cut_lineage(prints.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "id"))
    least = grouped.groupBy("root").agg(F.min("id").alias("component"))
    return cut_lineage(grouped.join(least, "root").select("fp", "root", "component"))


def least_of_groups(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``grouped`` (``id``, ``hash`` of the text, ``root``).

    It is the row of least id, null after all others; of several with that id that of least text hash,
    then of least row hash. Groups are told apart by root, so null and repeated ids lose nothing.
    """
    places = grouped.groupBy("root", "id", "hash").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "times")).alias("m")
    least = cut_lineage(places.groupBy("root").agg(first).select(F.col("m.id").alias("_id"), F.col("m.hash").alias("_hash"), F.col("m.times").alias("times")))
    rows = pack(docs, id=F.col(id_col), hash=F.xxhash64(text_col))
    met = rows.join(least, rows["id"].eqNullSafe(least["_id"]) & (rows["hash"] == least["_hash"]))
    # Only rows that share id and text with others have to meet; the rest, as a rule all, stay where they are.
    of_many = met.filter("times > 1").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return unpack(met.filter("times = 1").select("row").unionByName(of_many.select("row")), docs.columns)


def near_dedup_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component, chosen by ``least_of_groups``."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = cut_lineage(with_fingerprint(texts, "text", size, "fp").select("id", "fp", F.xxhash64("text").alias("hash")))
    comps = fingerprint_components(marked, max_bits)
    return least_of_groups(docs, marked.join(comps, "fp").select("id", "hash", "root"), id_col, text_col)
