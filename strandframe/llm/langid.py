"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is the product
(binding) of its letters' vectors, the first shifted (permuted) by two places and the second by
one. A text is the sum (bundle) of its trigrams' vectors, a language that of its texts, and a
document takes the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strandframe.llm.rows import pack, unpack

#: Length of all vectors.
DIMENSIONS = 512
#: Most languages that prototypes are made for; they are sent to every task.
MAX_LANGUAGES = 4096
UNKNOWN = "und"
_SPACE = 32
#: Most trigram vectors that a task keeps.
_KEEP = 1 << 16


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of anything else as one space, one at both ends."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate(([_SPACE], np.where(_is_letter()[code], code, _SPACE), [_SPACE])).astype(np.int64)
    return code[np.concatenate(([True], (code[1:] != _SPACE) | (code[:-1] != _SPACE)))]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different trigrams of a text, packed into 63 bits, and how often each comes."""
    code = letters(text or "")
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(code[:-2] << 42 | code[1:-1] << 21 | code[2:], return_counts=True)


class Vectors:
    """Trigram vectors made on first use and kept as rows of one table, up to ``_KEEP`` of them."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.letter = dimensions, {}
        self._reset()

    def _reset(self) -> None:
        self.keys = np.empty(0, np.int64)  # sorted
        self.rows = np.empty((0, self.dimensions), np.int8)

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            self.letter[code] = np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.letter[code]

    def _made(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << 21) - 1
        out = np.empty((len(keys), self.dimensions), np.int8)
        for i, k in enumerate(keys.tolist()):
            out[i] = np.roll(self.of_letter(k >> 42), 2) * np.roll(self.of_letter(k >> 21 & mask), 1) * self.of_letter(k & mask)
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Rows for sorted, different ``keys``."""
        new = np.setdiff1d(keys, self.keys, assume_unique=True)
        if len(new):
            if len(self.keys) + len(new) > _KEEP:
                self._reset()
                new = keys
            every = np.concatenate((self.keys, new))
            order = np.argsort(every, kind="stable")
            self.rows = np.concatenate((self.rows, self._made(new)))[order]
            self.keys = every[order]
        return self.rows[np.searchsorted(self.keys, keys)]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions, np.float64)
        for i in range(0, len(keys), 8192):
            total += counts[i:i + 8192].astype(np.float32) @ self.of(keys[i:i + 8192]).astype(np.float32)
        return total


_SHARED: dict[int, Vectors] = {}


def vectors(dimensions: int) -> Vectors:
    """The vectors of this worker process."""
    return _SHARED.setdefault(dimensions, Vectors(dimensions))


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: CRC-32 of the id as text leaves 2 when divided by 4; not a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each non-null language over all of ``docs``.

    A task adds up its batches' texts per language and hands on that sum, not the texts; Spark adds
    the sums by (language, coordinate). A text counts with length 1, however long it is.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def bundles(batches):
        v, totals = vectors(dimensions), {}
        for rows in batches:
            for lang, text in zip(rows["lang"], rows["text"]):
                one = v.bundle(*trigrams(text))
                if length := float(np.sqrt(one @ one)):
                    totals[lang] = totals.get(lang, 0.0) + one / length
            if len(totals) > 256:
                yield pd.DataFrame({"lang": list(totals), "total": [t.tolist() for t in totals.values()]})
                totals = {}
        if totals:
            yield pd.DataFrame({"lang": list(totals), "total": [t.tolist() for t in totals.values()]})

    sums = (
        docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInPandas(bundles, schema)
        .select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("total"))
        .limit(MAX_LANGUAGES + 1).collect()
    )
    if len(sums) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different languages: is {lang_col} a language column?")
    return {r["lang"]: np.round(np.array([x["x"] for x in r["total"]]), 6) for r in sums}


def predicted(spark: SparkSession, text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """Struct of ``lang_pred`` and ``score`` (cosine, at least 0).

    ``und`` with score 0 stands for a null text or one without a letter, or for all when there is no
    prototype. A text like no prototype has the language of largest cosine, with score 0. Of equal cosines the alphabetically first language wins. Only the text is looked at.
    """
    names = sorted(prototypes)
    dimensions = len(prototypes[names[0]]) if names else DIMENSIONS
    matrix = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in names]).reshape(-1, dimensions)
    sent = spark.sparkContext.broadcast(matrix)  # at most MAX_LANGUAGES rows

    def best(texts: pd.Series) -> pd.DataFrame:
        v, out = vectors(dimensions), []
        for text in texts:
            one = v.bundle(*trigrams(text))
            length = np.sqrt(one @ one)
            known = len(names) and len(letters(text or "")) > 2  # letters, even if their vectors cancel
            cosine = np.round(sent.value @ one / (length or 1.0), 9) if known else np.zeros(0)
            k = int(cosine.argmax()) if len(cosine) else -1
            out.append((names[k], min(max(float(cosine[k]), 0.0), 1.0)) if k >= 0 else (UNKNOWN, 0.0))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return F.pandas_udf(best, "lang_pred string, score double").asNondeterministic()(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, learned from those not held out.

    Columns named like the new ones are replaced; repeated rows stay; without any labelled row every
    prediction is ``und``.
    """
    prototypes = learn(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    out = pack(docs, held_out=held_out(F.col(id_col)), found=predicted(docs.sparkSession, F.col(text_col), prototypes))
    return unpack(out, docs.columns, held_out=F.col("held_out"), lang_pred=F.col("found.lang_pred"), score=F.col("found.score"))
