"""Language-model scores from a class-based bigram model with exchange clustering.

The probability of a word after another is ``P(class | class before) * P(word | class)``. Classes come
from the exchange algorithm: a word goes to the class where the likelihood of the training bigrams is
largest, all other words staying where they are, until hardly any word moves.

* Words are counted over all training documents. The most frequent ``VOCABULARY`` words get a class;
  the others, and unseen ones, are the class of rare words, whose counts are exact too.
* The ``CORE`` most frequent words are exchanged. Their neighbours are held as one row per word, and
  each round holds every row against the class counts of the round before, half of the words a round
  (neighbours that move at once would undo each other).
* Each other word of the vocabulary is placed once, by the same rule, from its neighbours in the core.
* Class bigrams are then counted over all training documents and smoothed.

A text ends with an end token, which is also what the first word of a text comes after.
Both bounds are sizes of the model, and what is sent to tasks is bounded by them.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.llm.rows import pack, unpack
from strandframe.session import cut_lineage

#: Classes that words are exchanged between.
CLASSES = 64
#: Most words that have a class of their own, and most that are exchanged.
VOCABULARY, CORE = 1 << 18, 1 << 13
#: Rounds of exchange, at most, and the share of the core that still moves when it ends earlier.
ROUNDS, SETTLED = 16, 0.002
#: Added to counts in the base score.
ADD = 0.1
#: The end of a text as a word; no word of a text can hold a line feed.
END = b"\n"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Different pairs or words that a task gathers before it hands them on.
_HELD = 1 << 20


def tokens(text: bytes | None) -> list:
    """Lower-cased (A-Z) words of a text."""
    return (text or b"").translate(_LOWER).split()


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: CRC-32 of the id as text is divisible by 10; not a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` and ``n``, how often it is in ``texts`` (column ``text``, binary); one end for each text."""
    def counts(batches):
        seen: dict = {}
        for rows in batches:
            for text in rows["text"]:
                words = tokens(text)
                words.append(END)
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > _HELD // 2:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen = {}
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return texts.select("text").mapInPandas(counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach."""
    # Counts above 2^16 are told apart to a sixteenth, so a row of the histogram is one of some 66,000.
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2("n")) - 4), F.lit(1.0))
    level = F.when(F.col("n") < 1 << 16, F.col("n")).otherwise((F.floor(F.col("n") / step) * step).cast("long"))
    least, total = None, 0
    for row in counts.filter(F.col("word") != END).groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        total += row["words"]
        if total > most:
            break
        least = row["level"]
    return least if least is not None else (1 << 62)


class Numbers:
    """Numbers of words: 0 the end, then the core, then the rest of the vocabulary; -1 for other words."""

    def __init__(self, words: list):
        self.of = {w: k for k, w in enumerate(words)}

    def line(self, texts) -> tuple[np.ndarray, list]:
        """The texts one after the other, each closed by an end, and the other words of each text."""
        words, ends = [], []
        for text in texts:
            words += tokens(text)
            words.append(END)
            ends.append(len(words))
        line = np.fromiter(map(self.of.get, words, itertools.repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(line < 0)
        cut = np.searchsorted(rare, ends).tolist()
        rare = [words[k] for k in rare.tolist()]
        return line, [rare[a:b] for a, b in itertools.pairwise([0, *cut])]


def _before(line: np.ndarray) -> np.ndarray:
    """What stands before each token; before the first, an end."""
    return np.concatenate(([0], line[:-1])).astype(line.dtype)


def _parts(texts: pd.Series, size: int = 1 << 22):
    """Parts of a batch of some 4 MB of text."""
    yield from (part for _, part in texts.groupby(np.cumsum([len(t or b"") for t in texts]) // size, sort=False))


def _summed(texts: DataFrame, keyed, width: int) -> DataFrame:
    """Sums ``n`` for each ``x``, ``y`` of the numbers ``x * width + y`` that ``keyed`` makes of a part of the texts."""
    def gathered(batches):
        held, size = [], 0
        for rows in batches:
            for part in _parts(rows["text"]):
                keys, n = np.unique(keyed(part), return_counts=True)
                held.append(pd.DataFrame({"key": keys, "n": n}))
                size += len(keys)
                if size > 4 * _HELD:
                    held = [pd.concat(held).groupby("key", as_index=False)["n"].sum()]
                    size = len(held[0])
                    if size > 2 * _HELD:
                        yield held.pop()
                        size = 0
        if held:
            yield pd.concat(held).groupby("key", as_index=False)["n"].sum()

    sums = texts.select("text").mapInPandas(gathered, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    y = F.pmod("key", F.lit(width))
    return sums.select(((F.col("key") - y) / width).cast("long").alias("x"), y.alias("y"), "n")


def _lists(pairs: DataFrame, by: str, other: str, name: str) -> DataFrame:
    """A row for each ``by`` with the numbers ``other`` (few and different, as a bound on them holds) and their counts."""
    of = F.sort_array(F.collect_list(F.struct(F.col(other).alias("id"), "n")))
    met = pairs.groupBy(F.col(by).alias("word")).agg(of.alias("of"))
    return met.select("word", F.col("of.id").alias(f"{name}_ids"), F.col("of.n").alias(f"{name}_n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(counts: np.ndarray, before: np.ndarray, after: np.ndarray, now: int, left: np.ndarray, right: np.ndarray, twice: float = 0.0) -> int:
    """The class, of those after the first, where a word makes the training bigrams likeliest.

    ``counts`` are class bigrams with margins ``before`` and ``after``; the word counts there as one
    of class ``now`` (-1: as none). ``left`` and ``right`` are the classes of its neighbours without
    itself, ``twice`` is how often it follows itself. The log-likelihood, up to a constant, is the sum of
    ``x log x`` over the bigrams less that over both margins. Of equal classes the present one wins,
    then the one with most bigrams.
    """
    own = (right.sum() + twice, left.sum() + twice)
    if now >= 0:
        counts, before, after = counts.copy(), before.copy(), after.copy()
        counts[:, now] -= left
        counts[now, :] -= right
        counts[now, now] -= twice
        before[now] -= own[0]
        after[now] -= own[1]
    l, r, self = np.flatnonzero(left), np.flatnonzero(right), np.diag(counts)
    cells = counts[l, :]
    gain = (_xlogx(cells + left[l, None]) - _xlogx(cells)).sum(axis=0)
    cells = counts[:, r]
    gain += (_xlogx(cells + right[None, r]) - _xlogx(cells)).sum(axis=1)
    gain += _xlogx(self + left + right + twice) + _xlogx(self) - _xlogx(self + left) - _xlogx(self + right)
    gain -= _xlogx(before + own[0]) - _xlogx(before) + _xlogx(after + own[1]) - _xlogx(after)
    gain[0] = -np.inf
    most = np.flatnonzero(gain >= gain.max() - 1e-9)
    return now if now in most else int(most[before[most].argmax()])


def _spread_counts(ids, n, of: np.ndarray, classes: int, word: int = -1) -> tuple[np.ndarray, float]:
    """Counts of neighbours by class, and how often the word is its own neighbour. Neighbours without a class are passed over."""
    ids, n = np.asarray(ids, np.int64), np.asarray(n, np.float64)
    self, known = ids == word, of[ids] >= 0
    return np.bincount(of[ids[known & ~self]], n[known & ~self], classes), float(n[self].sum())


def class_bigrams(rows: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Class bigrams of the core from its rows of neighbours."""
    sent = rows.sparkSession.sparkContext.broadcast(of)

    def counted(batches):
        total = np.zeros((classes, classes))
        for part in batches:
            for word, ids, n in zip(part["word"], part["right_ids"], part["right_n"]):
                if ids is not None and sent.value[word] >= 0:
                    total[sent.value[word]] += _spread_counts(ids, n, sent.value, classes)[0]
        x, y = np.nonzero(total)
        yield pd.DataFrame({"x": x, "y": y, "n": total[x, y].astype(np.int64)})

    return _matrix(rows.select("word", "right_ids", "right_n").mapInPandas(counted, "x long, y long, n long"), classes)


def _matrix(sums: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in sums.groupBy("x", "y").agg(F.sum("n").alias("n")).collect():  # at most size * size rows
        out[r["x"], r["y"]] = r["n"]
    return out


def _likelihood(counts: np.ndarray) -> float:
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(axis=0)).sum() - _xlogx(counts.sum(axis=1)).sum())


def exchange(rows: DataFrame, core: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each core word (the end has class 0 to itself) and the class bigrams.

    ``rows`` has a row for each of the ``core`` words with its neighbours. The most frequent words begin
    with a class each, the first round places the others. Of all rounds the likeliest classes are
    taken; rounds end when fewer than ``SETTLED`` of the core would move, at the latest after ``rounds``.
    """
    context, size = rows.sparkSession.sparkContext, classes + 1
    of = np.full(max(core, 1), -1, np.int64)
    of[:size] = np.arange(len(of[:size]))
    best = None
    for turn in range(rounds + 1):
        counts = class_bigrams(rows, of, size)
        if turn and (best is None or _likelihood(counts) > best[0]):
            best = (_likelihood(counts), of.copy(), counts)
        sent = context.broadcast((of, counts))

        def moves(batches):
            of, counts = sent.value
            before, after = counts.sum(axis=1), counts.sum(axis=0)
            for part in batches:
                out = []
                for word, li, ln, ri, rn in part[["word", "left_ids", "left_n", "right_ids", "right_n"]].itertuples(index=False):
                    if not word:
                        continue
                    none = np.empty(0, np.int64)
                    left, _ = _spread_counts(none if li is None else li, none if ln is None else ln, of, size, word)
                    right, twice = _spread_counts(none if ri is None else ri, none if rn is None else rn, of, size, word)
                    out.append((word, best_class(counts, before, after, int(of[word]), left, right, twice)))
                yield pd.DataFrame(out, columns=["word", "class"])

        found = rows.mapInPandas(moves, "word long, class long").toPandas()  # one row for each core word
        word, new = found["word"].to_numpy(np.int64), found["class"].to_numpy(np.int64)
        moving = of[word] != new
        if turn and (turn == rounds or moving.sum() <= SETTLED * len(word)):
            break
        # Half of the words at a time, a different half each round: words that move together undo each other's gain.
        moving &= (of[word] < 0) | ((word * 40503 >> turn % 8) % 2 == turn % 2)
        of[word[moving]] = new[moving]
    return best[1], best[2]


@dataclass
class Model:
    """Words with their counts and classes, and the base 10 logarithms the scores are sums of."""

    words: list  # of the vocabulary, the end first
    counts: np.ndarray
    classes: np.ndarray
    total: int  # training tokens
    types: int  # different ones
    transitions: np.ndarray  # log10 P(class | class before); the last class is that of rare words
    emissions: np.ndarray  # log10 P(word | its class) for the vocabulary
    rare_total: float  # rare tokens and a share for unseen words
    unseen: float  # that share

    def base(self, count):
        return np.log10((count + ADD) / (self.total + ADD * (self.types + 1)))


def smoothed(bigrams: np.ndarray, singles: float, rare_tokens: float) -> np.ndarray:
    """P(class | class before), Witten-Bell smoothed with the classes' own frequencies.

    The last class is that of rare words. Words seen once stand for as many unseen ones, so its
    counts rise by their share in it.
    """
    raised = bigrams.copy()
    raised[:, -1] *= 1 + singles / max(rare_tokens, 1.0)
    own = (raised.sum(axis=0) + 0.5) / (raised.sum() + 0.5 * len(raised))
    kinds = np.maximum((bigrams > 0).sum(axis=1, keepdims=True), 1)
    return (raised + kinds * own) / (raised.sum(axis=1, keepdims=True) + kinds)


def learn(texts: DataFrame, counts: DataFrame, classes: int = CLASSES, vocabulary: int = VOCABULARY, core: int = CORE) -> Model:
    """The model of ``texts`` (binary column ``text``) with their ``counts``.

    No texts give a model by which every word is unseen.
    """
    context = texts.sparkSession.sparkContext
    facts = counts.agg(F.sum("n").alias("total"), F.count("*").alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("singles")).first()
    # Words seen once are always rare: they stand for the unseen.
    least = [max(least_count(counts, most), 2) for most in (vocabulary, core)]
    listed = counts.filter((F.col("n") >= least[0]) & (F.col("word") != END)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    end = counts.filter(F.col("word") == END).first()
    words = [END, *map(bytes, listed["word"])]
    number = np.array([end["n"] if end else 0, *listed["n"]], np.int64)
    core = 1 + int((number[1:] >= least[1]).sum())
    numbers = context.broadcast(Numbers(words))

    def core_pairs(part):
        line, _ = numbers.value.line(part)
        before = _before(line)
        both = (before >= 0) & (before < core) & (line >= 0) & (line < core)
        return before[both] * core + line[both]

    pairs = cut_lineage(_summed(texts, core_pairs, core))
    rows = _lists(pairs, "x", "y", "right").join(_lists(pairs, "y", "x", "left"), "word", "full")
    rows = cut_lineage(rows.repartition(32, "word"))
    of, bigrams = exchange(rows, core, classes)

    # The rest of the vocabulary, by its neighbours in the core: left classes count from 0, right ones from size.
    size = classes + 1
    sent = context.broadcast(of)

    def contexts(part):
        line, _ = numbers.value.line(part)
        before = _before(line)
        to_left = (line >= core) & (before >= 0) & (before < core)
        to_right = (before >= core) & (line >= 0) & (line < core)
        return np.concatenate((line[to_left] * 2 * size + sent.value[before[to_left]], before[to_right] * 2 * size + size + sent.value[line[to_right]]))

    def places(batches):
        before, after = bigrams.sum(axis=1), bigrams.sum(axis=0)
        for part in batches:
            out = []
            for word, ids, n in zip(part["word"], part["of_ids"], part["of_n"]):
                both = np.bincount(np.asarray(ids, np.int64), np.asarray(n, np.float64), 2 * size)
                out.append((word, best_class(bigrams, before, after, -1, both[:size], both[size:])))
            yield pd.DataFrame(out, columns=["word", "class"])

    largest = 1 + int(bigrams.sum(axis=1)[1:].argmax())  # for words without a neighbour in the core
    full = np.full(len(words), largest, np.int64)
    full[:core] = np.where(of[:core] < 0, largest, of[:core])
    if len(words) > core:
        placed = _lists(_summed(texts, contexts, 2 * size), "x", "y", "of").mapInPandas(places, "word long, class long").toPandas()
        full[placed["word"]] = placed["class"]

    classed, rare = context.broadcast(full), size

    def classes_of(part):
        line, _ = numbers.value.line(part)
        kind = np.where(line < 0, rare, classed.value[line])
        return _before(kind) * (size + 1) + kind

    whole = _matrix(_summed(texts, classes_of, size + 1), size + 1)
    rare_tokens = float(facts["total"] or 0) - float(number.sum())
    unseen = float(facts["singles"] or 0) + 0.5
    of_class = np.bincount(full, number, size)
    emissions = np.log10(np.maximum(number, 0.5) / np.maximum(of_class[full], 0.5))
    return Model(words, number, full, int(facts["total"] or 0), int(facts["types"]), np.log10(smoothed(whole, unseen, rare_tokens)), emissions, rare_tokens + unseen, unseen)


_PART = "n_tokens long, n_known long, base double, score double, others array<binary>, times array<long>"


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` scored by ``model``; see ``score_documents``."""
    context = docs.sparkSession.sparkContext
    numbers, sent = context.broadcast(Numbers(model.words)), context.broadcast(model)

    def parts(texts: pd.Series) -> pd.DataFrame:
        m, out = sent.value, []
        of_base, of_known = m.base(m.counts), m.counts > 0
        for part in _parts(texts):
            line, others = numbers.value.line(part)
            listed = line >= 0
            kind = np.where(listed, m.classes[line], len(m.transitions) - 1)
            values = m.transitions[_before(kind), kind] + np.where(listed, m.emissions[line], 0.0)
            first = np.concatenate(([0], np.flatnonzero(line == 0)[:-1] + 1))
            rare = [dict() for _ in others]
            for seen, words in zip(rare, others):
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
            out.append(pd.DataFrame({
                "n_tokens": np.diff(np.append(first, len(line))), "n_known": np.add.reduceat(listed & of_known[line], first, dtype=np.int64),
                "base": np.add.reduceat(np.where(listed, of_base[line], 0.0), first), "score": np.add.reduceat(values, first),
                "others": [list(x) for x in rare], "times": [list(x.values()) for x in rare]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[c.split()[0] for c in _PART.split(", ")])

    udf = F.pandas_udf(parts, _PART).asNondeterministic()
    marked = pack(docs, held_out=held_out(F.col(id_col)), found=udf(F.col(text_col).cast("binary")))
    marked = cut_lineage(marked.withColumn("key", F.monotonically_increasing_id()))
    asked = marked.select("key", F.explode(F.arrays_zip("found.others", "found.times")).alias("o")).select("key", F.col("o.others").alias("word"), F.col("o.times").alias("m"))
    n = F.coalesce("n", F.lit(0))
    chance = F.when(n > 0, n).otherwise(F.lit(model.unseen)) / F.lit(model.rare_total)
    scale = F.lit(float(model.total + ADD * (model.types + 1)))
    met = asked.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("known"), F.sum(F.col("m") * F.log10((n + F.lit(ADD)) / scale)).alias("base"),
        F.sum(F.col("m") * F.log10(chance)).alias("score"))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = marked.join(met, "key", "left")
    total = F.col("found.score") + more("score")
    return unpack(
        out, docs.columns, held_out=F.col("held_out"), n_tokens=F.col("found.n_tokens"), n_known=F.col("found.n_known") + more("known"),
        train_tokens=F.lit(model.total).cast("long"), base_score=F.col("found.base") + more("base"), score=total,
        perplexity=F.pow(F.lit(10.0), -total / F.col("found.n_tokens")))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, vocabulary: int = VOCABULARY, core: int = CORE) -> DataFrame:
    """``docs`` with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity``.

    Learned from the documents not held out, whole texts and copies included. ``score`` is the model's
    log10 probability of the text with its end, ``base_score`` that of single words with 0.1 added to their
    counts; ``n_known`` counts tokens seen in training. A null or wordless text is an end alone. Rows
    are scored one by one: repeated rows stay, null ids are learned from. Columns named like the new
    ones are replaced. No rows give no rows; nothing to learn from makes every word unseen.
    """
    texts = docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).cast("binary").alias("text"))
    counts = cut_lineage(word_counts(texts))
    model = learn(texts, counts, classes, vocabulary, core)
    return score(docs, model, counts, id_col, text_col)
