"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Distances count words. An item of n words allows ``k = floor(n / 5)`` edits, a similarity of 0.8.

1. Seeds. Of ``k + 1`` equal pieces of an item at least one is untouched by k edits, so a window can
   only match where it shares a run of ``n // (k + 1)`` words with the item. Other windows need no
   embedding; none that could match is lost.
2. Embedding. The CGK random walk reads a string with a pointer that moves on or stays by a random
   bit of (step, symbol); strings at a small edit distance agree in most of the ``3 n`` steps.
3. Bit sampling. For each of ``repetitions`` walks a few steps are drawn; a window and an item of
   the same size are candidates when one repetition's drawn symbols are all equal.
4. Candidates are verified by the exact edit distance to the best place around the window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandframe.llm.rows import pack, unpack

#: Least similarity, 1 - edits / words of the item.
SIMILARITY = 0.8
#: Steps drawn in one repetition, the recall aimed at, and the share of steps at which strings at the limit agree (measured).
DRAWN, RECALL, AGREEMENT = 2, 0.999, 0.45
#: Most items and words in one index, which is sent to every task; more are worked off in several passes.
MAX_ITEMS = 20_000
MAX_WORDS = 2_000_000
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD = np.array([xxhash.xxh64_intdigest(b"place %d" % k) | 1 for k in range(64)], np.uint64)
_CACHE_WORDS = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) | 1  # zero is kept for what lies past the end
        return h


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words; all ASCII but letters and digits parts words."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int(n * (1 - similarity) + 1e-9)


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of ``q`` words."""
    if len(words) < q:
        return np.empty(0, np.uint64)
    out = words[:len(words) - q + 1] * _ODD[0]
    for k in range(1, q):
        out = out + (words[k:len(words) - q + 1 + k] ^ (words[k:len(words) - q + 1 + k] >> np.uint64(31))) * _ODD[k % 64] * np.uint64(2 * (k // 64) + 1)
    return (out ^ (out >> np.uint64(29))) * _ODD[63]


def repetitions(recall: float = RECALL, agreement: float = AGREEMENT, drawn: int = DRAWN) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**drawn))


class Walks:
    """The random bits and drawn steps of all repetitions."""

    def __init__(self, reps: int, drawn: int = DRAWN, seed: int = 5):
        self.reps, self.drawn = reps, drawn
        rng = np.random.Generator(np.random.PCG64(seed))
        self.where = rng.random((reps, drawn))
        self.seed, self.bits = seed, np.empty((0, reps), np.uint64)

    def _multipliers(self, steps: int) -> np.ndarray:
        if len(self.bits) < steps:
            size = 1 << (steps - 1).bit_length()
            self.bits = np.random.Generator(np.random.PCG64(self.seed + 1)).integers(0, 1 << 63, (size, self.reps), np.uint64) * np.uint64(2) + np.uint64(1)
        return self.bits

    def keys(self, windows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Key of each window (row) in each repetition (column). Rows are padded to their item's size."""
        out = np.empty((len(windows), self.reps), np.uint64)
        order = np.argsort(sizes, kind="stable")
        for i in range(0, len(order), 512):  # a block of similar sizes at a time
            block = order[i:i + 512]
            out[block] = self._block([windows[j] for j in block], sizes[block])
        return out

    def _block(self, windows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        longest = int(sizes.max())
        text = np.zeros((len(windows), longest + 1), np.uint64)
        for row, w in zip(text, windows):
            row[:len(w)] = w
        flat, base = text.ravel(), (np.arange(len(windows)) * (longest + 1))[:, None]
        end = np.repeat(sizes[:, None], self.reps, axis=1)
        at = np.zeros((len(windows), self.reps), np.int64)
        steps = (self.where[None] * (3 * sizes)[:, None, None]).astype(np.int64)  # window, repetition, drawn
        key = np.repeat(sizes[:, None].astype(np.uint64), self.reps, axis=1)
        bits = self._multipliers(3 * longest)
        last = int(steps.max()) + 1
        seen = np.empty((self.drawn, len(windows), self.reps), np.uint64)
        for j in range(last):
            symbol = flat[base + at]
            for d in range(self.drawn):
                np.copyto(seen[d], symbol, where=steps[:, :, d] == j)
            at = np.minimum(at + (symbol * bits[j] >> np.uint64(63)).astype(np.int64), end)
        for d in range(self.drawn):
            key = (key ^ seen[d]) * _ODD[d + 1]
            key ^= key >> np.uint64(32)
        return (key + np.arange(self.reps, dtype=np.uint64)) * _ODD[40]


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges [low, high) one after another, and each range's length."""
    n = high - low
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), n


@dataclass
class Index:
    """What tasks need of a set of items."""

    ids: list
    words: list[np.ndarray]
    walks: Walks
    seeds: dict  # run length -> (sorted hashes, item, position)
    buckets: np.ndarray  # sorted keys
    bucket_items: np.ndarray

    @staticmethod
    def of(items: list[tuple], reps: int | None = None) -> Index:
        """``items``: (id, text). Items without a word match nothing."""
        kept = [(i, w) for i, w in ((i, word_hashes(t)) for i, t in items) if len(w)]
        ids, words = [i for i, _ in kept], [w for _, w in kept]
        walks, seeds = Walks(repetitions() if reps is None else reps), {}
        for k, w in enumerate(words):
            q = len(w) // (edits_allowed(len(w)) + 1)
            g = grams(w, q)
            seeds.setdefault(q, []).append((g, np.full(len(g), k), np.arange(len(g))))
        packed = {}
        for q, parts in seeds.items():
            g, item, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(g, kind="stable")
            packed[q] = (g[order], item[order], pos[order])
        keys = walks.keys(words, np.array([len(w) for w in words], np.int64)) if words else np.empty((0, walks.reps), np.uint64)
        flat, owner = keys.ravel(), np.repeat(np.arange(len(words)), walks.reps)
        order = np.argsort(flat, kind="stable")
        return Index(ids, words, walks, packed, flat[order], owner[order])

    def __post_init__(self):
        self.maps, self.sizes = {}, np.array([len(w) for w in self.words], np.int64)
        for q, (g, _, _) in self.seeds.items():
            bits = np.zeros(1 << 20, bool)
            bits[(g >> np.uint64(44)).astype(np.int64)] = True
            self.maps[q] = bits

    def windows(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, start, size) of the windows that share a seed with an item of their size, each once."""
        lengths = np.array([len(t) for t in texts], np.int64)
        begin, found = np.cumsum(lengths) - lengths, [np.empty((0, 3), np.int64)]
        joined = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        for q, (g, item, pos) in self.seeds.items():
            h = grams(joined, q)
            at = np.flatnonzero(self.maps[q][(h >> np.uint64(44)).astype(np.int64)])
            of = np.searchsorted(begin, at, "right") - 1
            inside = at + q <= begin[of] + lengths[of]  # a run across two texts is none
            at, of = at[inside], of[inside]
            low, high = np.searchsorted(g, h[at], "left"), np.searchsorted(g, h[at], "right")
            which, n = _spans(low, high)
            of = np.repeat(of, n)
            start = np.maximum(np.repeat(at, n) - begin[of] - pos[which], 0)
            found.append(np.stack([of, start, self.sizes[item[which]]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def candidates(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that share a bucket."""
        flat = keys.ravel()
        low, high = np.searchsorted(self.buckets, flat, "left"), np.searchsorted(self.buckets, flat, "right")
        which, n = _spans(low, high)
        pairs = np.unique(np.stack([np.repeat(np.arange(len(flat)), n) // max(keys.shape[1], 1), self.bucket_items[which]], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the substring of ``text`` nearest to ``item``; the first end of equal ones."""
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)  # a match may begin anywhere
    for k, w in enumerate(item.tolist()):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


def find(index: Index, texts: list[np.ndarray]) -> list[list[tuple]]:
    """Per text its leaks as (item id, start, end, edits), best place first found, one per item and passage."""
    every = index.windows(texts)
    out: list[list[tuple]] = [[] for _ in texts]
    for i in range(0, len(every), 4096):  # so that the embedding of many windows stays small
        part = every[i:i + 4096]
        rows = [texts[o][s:s + n] for o, s, n in part.tolist()]
        window, item = index.candidates(index.walks.keys(rows, part[:, 2]))
        for w, k in zip(window.tolist(), item.tolist()):
            o, start, n = part[w].tolist()
            words, text = index.words[k], texts[o]
            most = edits_allowed(len(words))
            if any(x[0] == k and start < x[2] and x[1] < start + n for x in out[o]):
                continue
            if np.array_equal(text[start:start + n], words):
                out[o].append((k, start, start + n, 0))
                continue
            low = max(start - most, 0)
            region = text[low:start + len(words) + most]
            edits, end = best_place(words, region)
            if edits <= most:
                back, length = best_place(words[::-1], region[:end][::-1])
                out[o].append((k, low + end - length, low + end, edits))
    return [[(index.ids[k], s, e, d) for k, s, e, d in found] for found in out]


LEAK = "array<struct<item_id:{kind},start:long,end:long,edits:long>>"


def with_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    name: str = "leaks", max_items: int = MAX_ITEMS, max_words: int = MAX_WORDS,
) -> DataFrame:
    """``docs`` with ``name``: the passages (in words) that hold an item within its allowed edits.

    Rows keep their place: no shuffle, whatever a passage's or an item's frequency. Null texts and
    texts without words have no leaks; items that are null or without words match nothing; items of
    equal text are all named; overlapping places of one item are one leak, with the edits of the
    first place found. The items are sent to every task at most about ``max_items`` and
    ``max_words`` words at a time (or one item that is longer), in as many passes as that takes.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    size = items.agg(F.count("*").alias("n"), F.sum(F.size(F.split(F.coalesce(item_text, F.lit("")), r"\s+"))).alias("words")).first()
    passes = max(1, math.ceil(size["n"] / max_items), math.ceil((size["words"] or 0) / max_words))
    out, parts = pack(docs, text=F.col(text_col)), []
    for k in range(passes):
        part = F.pmod(F.xxhash64(item_id, item_text), F.lit(passes)) == k
        rows = items.filter(part).select(item_id, item_text).collect()  # about max_items of them
        sent = spark.sparkContext.broadcast(Index.of(sorted((tuple(r) for r in rows), key=repr)))
        find_leaks = F.pandas_udf(_finder(sent), LEAK.format(kind=kind)).asNondeterministic()
        out, parts = out.withColumn(f"leaks{k}", find_leaks("text")), [*parts, f"leaks{k}"]
    return unpack(out, docs.columns, **{name: F.concat(*parts)})


def _finder(sent):
    def leaks(texts: pd.Series) -> pd.Series:
        found = []
        for i in range(0, len(texts), 500):
            found += find(sent.value, [word_hashes(t) for t in texts.iloc[i:i + 500]])
        return pd.Series([[dict(zip(("item_id", "start", "end", "edits"), x)) for x in row] for row in found])

    return leaks


def leaks_of(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per leak: the document's id, ``item_id``, ``start``, ``end`` and ``edits``."""
    found = with_leaks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items)
    return found.select(F.col("id").alias(id_col), F.explode("leaks").alias("leak")).select(id_col, "leak.*")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents without a leak, with the columns of ``docs``."""
    found = with_leaks(pack(docs, text=F.col(text_col)), items)
    return unpack(found.filter(F.size("leaks") == 0), docs.columns)
