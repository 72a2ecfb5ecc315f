"""Periodic runs of words, found with string synchronising sets.

A run is a maximal stretch of words with smallest period ``q`` that is at least ``least`` words and
``POWERS`` periods long. At scale ``t`` (a power of two) position ``i`` synchronises when the least
hash of the ``t``-word substrings that start in ``i..i+t`` is that at ``i`` or at ``i+t``; that
depends on the next ``2t`` words only, so equal contexts choose alike. A run of period ``q`` in
``2t <= q < 4t`` holds such a position followed by an equal one ``q`` words on, both with their
contexts, unless a stretch there has a period of at most a third of ``t``. Pairs of equal contexts
at a distance in that range therefore propose all periods of the scale; they are extended word by
word. Stretches of small period take no part in the minima. Their periods come from smaller scales,
the smallest from comparing the words a few places apart.

Texts are put in line with a separator that occurs once between two of them, so one pass of array
operations serves many texts and no run crosses from one to the next.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.llm.rows import pack, unpack

#: A run is at least this many periods long.
POWERS = 3
#: Least words of a run.
LEAST = 24
#: Periods below this are found by direct comparison; it is twice the first scale.
DIRECT = 8
#: Words, about, that are taken in one pass.
PASS_WORDS = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _doubled(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of substrings of twice ``length`` from those of ``length``."""
    return _mixed(h[:len(h) - length] * _MIX[0] + h[length:])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done, out = 1, x
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    return np.minimum(out[:len(x) - width + 1], out[width - done:][:len(x) - width + 1])


def _stretches(equal: np.ndarray, least: int) -> np.ndarray:
    """Start and end of the stretches of at least ``least`` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    found = edge.reshape(-1, 2)
    return found[found[:, 1] - found[:, 0] >= least]


def _same(ids: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from ``i`` on (``step`` 1) or back (-1) equal those ``q`` further right."""
    room = len(ids) - q - i if step > 0 else i + 1
    done, width = 0, 64
    while done < room:
        width = min(width, room - done)
        at = slice(i + done, i + done + width) if step > 0 else slice(i - done - width + 1, i - done + 1)
        same = ids[at] == ids[at.start + q:at.stop + q]
        if not same.all():
            return done + int((same if step > 0 else same[::-1]).argmin())
        done, width = done + width, width * 4
    return done


def synchronising(h: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """Synchronising positions for hashes ``h`` of ``t``-word substrings, those in ``periodic`` left out."""
    order = np.where(periodic, np.uint64(2**64 - 1), h)
    if len(order) <= t:
        return np.empty(0, np.int64)
    least = _window_min(order, t + 1)
    n = len(least)
    return np.flatnonzero(((order[:n] == least) | (order[t:t + n] == least)) & (least < np.uint64(2**64 - 1)))


def runs_in_line(ids: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Runs as rows (start, length, period) by start and period in one line of word numbers.

    ``longest`` is the length of the longest text in the line.
    """
    n, found = len(ids), Found()
    loose = {}  # stretches of small period, those too short for a run included
    for q in range(1, min(DIRECT - 1, n - 1) + 1):
        ends = _stretches(ids[q:] == ids[:-q], 1)
        ends = np.column_stack((ends[:, 0], ends[:, 1] + q))  # of the stretch with period q
        loose[q] = ends
        long = ends[ends[:, 1] - ends[:, 0] >= max(least, POWERS * q)]
        found.add(q, long[~found.covers(long, q)])
    t, h = 1, _mixed(ids.astype(np.uint64) * _MIX[0] + _MIX[1])
    while POWERS * 2 * t <= longest:
        if 2 * t >= DIRECT and len(h) > t:
            _runs_of_scale(ids, h, t, least, found, loose)
        if len(h) <= t:
            break
        h, t = _doubled(h, t), 2 * t
    out = np.concatenate([np.column_stack((r[:, 0], r[:, 1] - r[:, 0], np.full(len(r), q))) for q, r in found.ends.items()] or [np.empty((0, 3), np.int64)])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class Found:
    """Start and end of the runs of each period, by start. Those of one period overlap by less than it, so ends rise too."""

    def __init__(self):
        self.ends: dict[int, np.ndarray] = {}

    def add(self, q: int, ends: np.ndarray) -> None:
        if len(ends):
            self.ends[q] = ends

    def covers(self, ends: np.ndarray, q: int) -> np.ndarray:
        """Which stretches have a smaller period. It divides ``q``, and the run that holds the stretch was found before."""
        out = np.zeros(len(ends), bool)
        for p in {x for d in range(1, int(q**0.5) + 1) if q % d == 0 for x in (d, q // d)} & self.ends.keys() - {q}:
            runs = self.ends[p]
            at = np.searchsorted(runs[:, 0], ends[:, 0], "right") - 1
            out |= (at >= 0) & (runs[at, 1] >= ends[:, 1])
        return out


def _runs_of_scale(ids: np.ndarray, h: np.ndarray, t: int, least: int, found: Found, loose: dict) -> None:
    """Adds the runs with periods from 2t up to 4t."""
    periodic = np.zeros(len(h) + 1, np.int32)
    small = [loose[q] for q in range(1, t // 3 + 1) if q in loose]
    small += [r for q, r in found.ends.items() if DIRECT <= q <= t // 3]
    for ends in small:
        ends = ends[ends[:, 1] - ends[:, 0] >= t]
        np.add.at(periodic, ends[:, 0], 1)
        np.add.at(periodic, np.minimum(ends[:, 1] - t + 1, len(h)), -1)
    places = synchronising(h, t, np.cumsum(periodic)[:-1] > 0)
    context = _doubled(h, t)
    places = places[places < len(context)]
    order = np.argsort(context[places], kind="stable")
    places, same = places[order], context[places][order]
    proposed = []
    for k in range(1, len(places)):
        alike = same[k:] == same[:-k]
        gap = places[k:] - places[:-k]
        near = alike & (gap < 4 * t)
        if not near.any():  # equal contexts further on in the order are further away
            break
        fits = near & (gap >= 2 * t)
        proposed.append(np.column_stack((gap[fits], places[:-k][fits])))
    pairs = np.concatenate(proposed) if proposed else np.empty((0, 2), np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    for of_period in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1):
        out, last = [], 0
        for q, i in of_period.tolist():
            if i + q < last:
                continue
            start, last = i - _same(ids, i - 1, q, -1), i + _same(ids, i, q, 1) + q
            if last - start >= max(least, POWERS * q):
                out.append((start, last))
        if out:
            long = np.array(out, np.int64)
            found.add(q, long[~found.covers(long, q)])


def runs_of(texts: list[list], least: int = LEAST) -> list[np.ndarray]:
    """Runs of each list of words."""
    out: list = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    for at in _parts([len(texts[k]) + 1 for k in order], PASS_WORDS):
        known: dict = {}
        line, first = [], [0]
        for n, k in enumerate(order[at]):
            line += [known.setdefault(w, len(known)) for w in texts[k]]
            line.append(-1 - n)  # occurs once
            first.append(len(line))
        found = runs_in_line(np.array(line, np.int64), len(texts[order[at][-1]]), least)
        cut = np.searchsorted(found[:, 0], first)
        for n, k in enumerate(order[at]):
            out[k] = found[cut[n]:cut[n + 1]] - np.array([first[n], 0, 0])
    return out


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words but those that any run holds after its first period."""
    if not len(runs):
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs.tolist():
        gone[start + period:start + length] = True
    return [w for w, x in zip(words, gone.tolist()) if not x]


def _parts(sizes: list, most: int):
    """Slices of neighbours that add up to less than ``most``, or of one that does not."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if k > first and total + size >= most:
            yield slice(first, k)
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def with_runs(text: Column, least: int = LEAST) -> Column:
    """Struct of ``runs`` (array of start, length, period in words) and ``collapsed`` (text of the kept words)."""
    def find(rows: pd.Series) -> pd.DataFrame:
        texts = [t or b"" for t in rows]
        runs, kept = [None] * len(texts), [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        for at in _parts([len(texts[k]) for k in order], 6 * PASS_WORDS):
            part = order[at]
            words = [texts[k].split() for k in part]  # bytes split at \x20 and \x09-\x0D
            for k, w, found in zip(part, words, runs_of(words, least)):
                runs[k] = [{"start": s, "length": n, "period": q} for s, n, q in found.tolist()]
                kept[k] = b" ".join(collapsed(w, found)).decode("utf-8", "replace")
        return pd.DataFrame({"runs": runs, "collapsed": kept})

    schema = "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return F.pandas_udf(find, schema).asNondeterministic()(text.cast("binary"))


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed`` of each whole text.

    A null or empty text has no run and an empty ``collapsed``. Rows are judged one by one: repeated
    rows stay and null ids do not matter. Columns named like the new ones are replaced. No rows give
    no rows. A text's words are in one task, as every other column of it is.
    """
    out = pack(docs, found=with_runs(F.col(text_col), least))
    return unpack(out, docs.columns, runs=F.col("found.runs"), collapsed=F.col("found.collapsed"))


def digests(runs: Column, kept: Column) -> dict[str, Column]:
    """Columns that sum up the runs of a text: their number, the one of greatest exponent and two hashes."""
    # length/period of two runs is compared exactly: a/b > c/d as a*d > c*b
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])
    top = F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
    line = F.transform(runs, lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return {
        "n_runs": F.size(runs).cast("long"), "start": top["start"], "length": top["length"], "period": top["period"],
        "exponent_milli": F.floor(F.lit(1000) * top["length"] / top["period"]).cast("long"),
        "runs_sha256": F.sha2(F.array_join(line, "").cast("binary"), 256), "collapsed_sha256": F.sha2(kept.cast("binary"), 256)}


def repeat_parts(doc_id: Column, text: Column) -> Column:
    """Text in which every tenth document has a part repeated over its end, as its id's CRC-32 says.

    With ``h`` the CRC-32 of the decimal id and ``g = h // 10``, a text of ``n > 0`` words whose ``h``
    is divisible by 10 has word ``i >= a`` replaced by word ``a + (i - a) % p``, where ``a = g % n`` and
    ``p = 1 + (n - a) // (3 + g % 8)``. Null ids leave the text as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def woven(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    once = F.transform(F.array(words), woven)[0]  # as a variable of the lambda, the words are found once and not for each place
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), once).otherwise(text)
