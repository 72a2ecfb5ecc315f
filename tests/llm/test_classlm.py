"""Class-based bigram scores: the base score against brute force, the model as a probability, exchange on planted classes."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import classlm
from strandframe.llm.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(rows):
    """(held out, tokens, known, training tokens, base score) of each row."""
    words = [[*WORD.findall((t or "").translate(LOWER)), "\n"] for _, t in rows]
    out_of = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    seen = collections.Counter(w for ws, o in zip(words, out_of) if not o for w in ws)
    total = sum(seen.values())
    scale = total + 0.1 * (len(seen) + 1)
    return [(o, len(ws), sum(seen[w] > 0 for w in ws), total, sum(math.log10((seen[w] + 0.1) / scale) for w in ws)) for ws, o in zip(words, out_of)]


def held_against(got, rows):
    assert len(got) == len(rows)
    want = collections.defaultdict(list)
    for (i, t), b in zip(rows, brute_base(rows)):
        want[i, t].append(b)
    for r in got:
        b = want[r.doc_id, r.text].pop()
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == b[:4]
        assert r.base_score == pytest.approx(b[4], rel=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_base_score_brute_force_and_better_model(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = classlm.score_documents(df).collect()
    held_against(got, rows)
    query = {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in QUERIES["op11_class_bigrams"](spark, SF_DIR).collect()}
    assert query == {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_rows_and_small_vocabulary(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One one ONE two"), (4, "One one ONE two"), (None, "two three"), (36, "two " * 50_000), (37, "x" * 100_000 + " two")]
    rows += [(k, f"one two w{k} ten w{k}") for k in range(100, 180)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = classlm.score_documents(df)
    assert out.columns == ["doc_id", "text", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    held_against(out.collect(), rows)
    held_against(classlm.score_documents(df, classes=3, vocabulary=4, core=2).collect(), rows)
    assert classlm.score_documents(df.limit(0)).count() == 0
    unseen = [next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)]
    alone = spark.createDataFrame([(unseen[0], "nothing to learn from")], "doc_id long, text string")
    got = classlm.score_documents(alone).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (5, 0, 0) and math.isfinite(got.score)


def test_probabilities_add_up(spark):
    rows = [(k, " ".join(random.Random(k).choices("a b c d e f rare%d" % k, k=1) * 2 + list("abcdef"[k % 6:]))) for k in range(60)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("text").cast("binary").alias("text"))
    texts = spark.createDataFrame([(f"{t.decode()} once{k}".encode(),) for k, (t,) in enumerate(texts.collect())], "text binary")
    counts = classlm.word_counts(texts)
    for sizes in ((3, 1 << 18, 1 << 13), (3, 4, 2)):
        m = classlm.learn(texts, counts, *sizes)
        assert np.allclose((10 ** m.transitions).sum(axis=1), 1)
        for c in range(len(m.transitions) - 1):
            if (m.classes == c).any():
                assert (10 ** m.emissions[m.classes == c]).sum() == pytest.approx(1)
        rare = {r.word: r.n for r in counts.collect() if bytes(r.word) not in set(m.words)}
        assert (sum(rare.values()) + m.unseen) / m.rare_total == pytest.approx(1)
        assert sum(m.counts) + sum(rare.values()) == m.total


def brute_gain(bigrams, of, word, c, size):
    """Log-likelihood, up to a constant, with ``word`` in class ``c``."""
    of = {**of, word: c}
    n = np.zeros((size, size))
    for (a, b), k in bigrams.items():
        n[of[a], of[b]] += k
    return classlm._likelihood(n), n


def test_best_class_brute_force():
    draw = random.Random(2)
    for _ in range(60):
        size, words = draw.randrange(3, 6), range(draw.randrange(4, 9))
        of = {w: draw.randrange(1, size) if w else 0 for w in words}
        bigrams = {(a, b): draw.randrange(1, 9) for a, b in itertools.product(words, words) if draw.random() < 0.5}
        word = draw.randrange(1, len(words))
        gains = [brute_gain(bigrams, of, word, c, size)[0] for c in range(size)]
        _, counts = brute_gain(bigrams, of, word, of[word], size)
        left, right = np.zeros(size), np.zeros(size)
        for (a, b), k in bigrams.items():
            if a != b:
                left[of[a]] += k * (b == word)
                right[of[b]] += k * (a == word)
        found = classlm.best_class(counts, counts.sum(axis=1), counts.sum(axis=0), of[word], left, right, bigrams.get((word, word), 0))
        assert gains[found] == pytest.approx(max(gains[1:]))


def test_exchange_finds_planted_classes(spark):
    draw = random.Random(1)
    kinds = [[f"{kind}{k}" for k in range(12)] for kind in "nva"]
    texts = [(" ".join(draw.choice(kinds[(s + p) % 3]) for p in range(30)).encode(),) for s in range(3) for _ in range(60)]
    df = spark.createDataFrame(texts, "text binary")
    m = classlm.learn(df, classlm.word_counts(df), 3)
    of = collections.defaultdict(set)
    for w, c in zip(m.words[1:], m.classes[1:]):
        of[chr(w[0])].add(int(c))
    assert sorted(len(c) for c in of.values()) == [1, 1, 1] and len(set.union(*of.values())) == 3
    # a word outside the core is placed by its neighbours
    few = classlm.learn(df, classlm.word_counts(df), 3, core=24)
    assert len(few.words) == 37 and (few.classes[1:] > 0).all()
