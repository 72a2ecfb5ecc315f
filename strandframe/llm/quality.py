"""Quality rules under weak supervision.

Each rule votes good (1), bad (2) or abstains (0). How far a rule can be trusted is not set by
hand: expectation-maximisation over the counts of vote patterns estimates the rules' accuracies
and the share of good documents, and a document's verdict is its posterior probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from strandframe.llm.rows import pack, unpack

#: Fixed values: (fact, good when at most, bad when at least); between the two the rule abstains.
LOW_IS_GOOD = (
    ("symbols_per_word", 0.02, 0.1),
    ("upper_share", 0.15, 0.4),
    ("shouts_per_word", 0.03, 0.15),
    ("dup_line_share", 0.1, 0.3),
    ("repeat_share", 0.1, 0.3),
    ("digit_share", 0.05, 0.2),
)
#: Fixed values: (fact, bad when at most, good when at least).
HIGH_IS_GOOD = (
    ("alpha_word_share", 0.6, 0.85),
    ("full_stop_share", 0.2, 0.6),
    ("function_word_share", 0.02, 0.08),
    ("chars_per_word", 2.0, 3.0),
)
RULES = tuple(r[0] for r in LOW_IS_GOOD + HIGH_IS_GOOD)
#: Common function words of the languages covered.
FUNCTION_WORDS = (
    "a al als an and are as at auch auf avec be by con dans das de del dem den der des die du ein eine el en es "
    "est et for from für has have im in is ist it la las le les los mit not of on or para par pas por pour que qui se "
    "sich son su sur that the this to un una une und von was with y zu")

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FUNCTION = frozenset(FUNCTION_WORDS.encode().split())
_UPPER, _DIGITS, _STOPS = LETTERS[:26], b"0123456789", (b".", b"!", b"?", b'."', b":")

FACTS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("pattern", T.LongType())])


def _deleted(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeat_words(words: list) -> int:
    """Words inside three-word windows that the text holds twice or more, first ones included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n + 2)
    pair = w[:-1] * len(ids) + w[1:]
    pair = np.unique(pair, return_inverse=True)[1] if len(ids) > 2_000_000 else pair
    key = pair[:-1] * len(ids) + w[2:]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    if not twice.any():
        return 0
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k:n + k] |= twice
    return int(covered.sum())


def facts(text: bytes | None) -> tuple[dict, dict]:
    """Counts of the base rules, and the facts that the voting rules look at, of one whole text."""
    text = text or b""
    words = text.split()  # at space, \t, \n, \v, \f and \r
    solid = b"".join(words)
    n, lines = len(words), [x for x in text.split(b"\n") if x.strip()]
    inner = len(solid) - _deleted(solid, bytes(range(0x80, 0xC0)))  # code points: bytes that continue none
    base = {
        "n_words": n, "word_chars": inner, "n_symbols": _deleted(solid, SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(words)}
    upper, letters = _deleted(solid, _UPPER), _deleted(solid, LETTERS)
    per = max(n, 1)
    seen = {
        "symbols_per_word": base["n_symbols"] / per, "upper_share": upper / max(letters, 1),
        "shouts_per_word": solid.count(b"!") / per, "dup_line_share": base["n_dup_lines"] / max(len(lines), 1),
        "repeat_share": base["n_repeat_words"] / per, "digit_share": _deleted(solid, _DIGITS) / max(inner, 1),
        "alpha_word_share": sum(w[:-1].isalpha() or w.isalpha() or not w.isascii() for w in words) / per,
        "full_stop_share": sum(x.rstrip().endswith(_STOPS) for x in lines) / max(len(lines), 1),
        "function_word_share": sum(w in _FUNCTION for w in words) / per, "chars_per_word": inner / per}
    return base, seen


def votes(seen: dict) -> list[int]:
    low = [1 if seen[f] <= good else 2 if seen[f] >= bad else 0 for f, good, bad in LOW_IS_GOOD]
    high = [1 if seen[f] >= good else 2 if seen[f] <= bad else 0 for f, bad, good in HIGH_IS_GOOD]
    return low + high


def pattern(v: list[int]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


def _fact_frame(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, seen = facts(text)
        rows.append((*base.values(), pattern(votes(seen))))
    return pd.DataFrame(rows, columns=FACTS.names)


def estimate(patterns: dict[int, int], n_rules: int = len(RULES), tol: float = 1e-9):
    """(share of good documents, [(accuracy on good ones, on bad ones) per rule], posterior per pattern) by EM.

    ``patterns`` counts documents by vote pattern, at most ``3 ** n_rules`` of them whatever the
    corpus. Given the class rules err independently; when a rule abstains says nothing. A rule's
    two accuracies are the shares of its votes that are right among good and among bad documents,
    since a rule made for one fault rightly stays good on documents with another. The first guess
    takes documents with a bad vote for bad; that also fixes which class is which.
    """
    keys = np.array(sorted(patterns), dtype=np.int64)
    count = np.array([patterns[k] for k in keys], dtype=float)
    vote = keys[:, None] // 3 ** np.arange(n_rules) % 3
    good, bad = (vote == 1).astype(float), (vote == 2).astype(float)
    post, before = np.where(bad.any(axis=1), 0.1, 0.95), None
    share, on_good, on_bad = 0.5, np.full(n_rules, 0.9), np.full(n_rules, 0.5)
    while count.sum() and (before is None or np.abs(post - before).max() > tol):
        before, w1, w0 = post, count * post, count * (1 - post)
        share = min(max(float(w1.sum() / count.sum()), 0.01), 0.99)
        on_good = (w1 @ good + 9) / (w1 @ (good + bad) + 10)
        on_bad = (w0 @ bad + 1) / (w0 @ (good + bad) + 4)
        odds = math.log(share / (1 - share)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
        post = 1 / (1 + np.exp(np.clip(-odds, -700, 700)))
    return share, list(zip(on_good.tolist(), on_bad.tolist())), dict(zip(keys.tolist(), post.tolist()))


def quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``good_probability`` and ``kept``.

    Base rules fail texts of under 50 words and those with over half of their words in repeated
    three-word windows; a null text has no words. Others are kept when their posterior is at least
    ``threshold``. Votes are counted over all documents. Columns named like the new ones are
    replaced; equal rows get equal verdicts; no rows give no rows.

    The texts are read twice, once to count vote patterns and once for the result, so that neither
    texts nor links between rows and facts have to be stored.
    """
    udf = F.pandas_udf(_fact_frame, FACTS).asNondeterministic()  # so that no filter above makes Spark run it twice
    seen = pack(docs, facts=udf(F.col(text_col).cast("binary")))
    counted = {r["p"]: r["n"] for r in seen.groupBy(F.col("facts.pattern").alias("p")).agg(F.count("*").alias("n")).collect()}
    _, _, posterior = estimate(counted)
    spark = docs.sparkSession
    table = spark.createDataFrame(list(posterior.items()), "pattern long, good double")
    joined = seen.withColumn("pattern", F.col("facts.pattern")).join(F.broadcast(table), "pattern", "left")  # at most 3^10 rows
    n, repeated = F.col("facts.n_words"), F.col("facts.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > 50 * n)
    return unpack(joined, docs.columns, **{c: F.col(f"facts.{c}") for c in FACTS.names[:-1]},
                  base_failed=failed, good_probability=F.col("good"), kept=~failed & (F.col("good") >= threshold))
