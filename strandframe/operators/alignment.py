"""Global alignment of sequences to references as a Spark job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandframe.operators.joins import pair_all
from strandframe.session import maybe_broadcast

# Match, mismatch and gap scores.
MATCH, MISMATCH, GAP = 5, -4, -8


# Steps of a path: both letters, a gap in the test sequence, a gap in the reference.
BOTH, ALONG, DOWN = 0, 1, 2
#: Steps held at once by an alignment, and rows of scores kept for each level of its traceback.
CELLS, PARTS = 1 << 25, 64


def _next_row(row: np.ndarray, letter: int, r: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after one more test letter, and those of the diagonal steps alone."""
    diagonal = row[:-1] + np.where(r == letter, row.dtype.type(MATCH), row.dtype.type(MISMATCH))
    best = row + row.dtype.type(GAP)
    np.maximum(best[1:], diagonal, out=best[1:])
    best -= slope
    np.maximum.accumulate(best, out=best)
    best += slope
    return best, diagonal


def _trace(t: np.ndarray, r: np.ndarray, row: np.ndarray, first: int, last: int, j: int, path: list[int]) -> int:
    """Append the steps from (last, j) back to test letter ``first``, whose scores are ``row``; the column reached.

    Blocks of more than CELLS steps are cut into at most PARTS blocks of rows. Their first rows are
    kept and the blocks are worked off from the last one, each only up to the column it is entered at.
    """
    row, r_here = row[: j + 1], r[:j]
    slope = (np.arange(j + 1) * GAP).astype(row.dtype)
    cells = (last - first) * (j + 1)
    if cells > CELLS and last - first > 1:
        parts = min(PARTS, -(-cells // CELLS), last - first)
        cuts = [first + (last - first) * k // parts for k in range(parts + 1)]
        starts = [row]
        for k in range(parts - 1):
            for i in range(cuts[k], cuts[k + 1]):
                row, _ = _next_row(row, t[i], r_here, slope)
            starts.append(row)
        for k in reversed(range(parts)):
            j = _trace(t, r, starts.pop(), cuts[k], cuts[k + 1], j, path)
        return j
    steps = np.empty((last - first, j + 1), np.uint8)
    for i in range(first, last):
        row, diagonal = _next_row(row, t[i], r_here, slope)
        here = steps[i - first]
        here[0] = DOWN
        here[1:] = np.where(row[1:] == diagonal, BOTH, np.where(row[1:] == row[:-1] + GAP, ALONG, DOWN))
    i = last
    while i > first:
        step = steps[i - first - 1, j]
        path.append(step)
        i -= step != ALONG
        j -= step != DOWN
    return j


def align_pair(test: str, ref: str) -> tuple[str, str, int]:
    """Both strings padded with '-' and their score.

    One numpy pass per test letter. Among equal scores a diagonal step wins, then a
    gap in the test sequence. The traceback keeps at most CELLS steps (one row of them at least) and
    PARTS rows of scores for each level of blocks, so memory grows with the reference and not with
    the product of the lengths; rows are computed again once for each level.
    """
    t = np.frombuffer(test.encode("utf-32-le"), np.uint32)
    r = np.frombuffer(ref.encode("utf-32-le"), np.uint32)
    n, m = len(t), len(r)
    kind = np.int32 if -GAP * (n + m) < 2**31 else np.int64
    back: list[int] = []
    j = _trace(t, r, (np.arange(m + 1) * GAP).astype(kind), 0, n, m, back)
    path = np.concatenate([np.full(j, ALONG, np.uint8), np.array(back, np.uint8)[::-1]])
    dash = np.uint32(ord("-"))
    x = np.append(t, dash)[np.where(path == ALONG, n, np.cumsum(path != ALONG) - 1)]
    y = np.append(r, dash)[np.where(path == DOWN, m, np.cumsum(path != DOWN) - 1)]
    both = path == BOTH
    equal = int(np.count_nonzero(both & (x == y)))
    score = MATCH * equal + MISMATCH * (int(both.sum()) - equal) + GAP * int((~both).sum())
    return x.tobytes().decode("utf-32-le"), y.tobytes().decode("utf-32-le"), score


def _align_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [align_pair(t, r) for t, r in zip(pdf["seq"], pdf["ref_seq"])]
        yield pd.DataFrame({
            "digest": pdf["digest"], "ref_id": pdf["ref_id"],
            "aligned": [d[0] for d in done], "aligned_ref": [d[1] for d in done], "score": [d[2] for d in done],
        })


def align_to_refs(seqs: DataFrame, refs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Alignment of every distinct sequence to every reference: (digest, ref_id, aligned, aligned_ref, score).

    Copies are aligned once. Pairs (digest, ref_id) of ``known`` are left out before any text moves.
    Rows without a text are not aligned. Pairs are spread evenly before the costly step.
    """
    unique = seqs.filter("seq IS NOT NULL").select(F.md5("seq").alias("digest"), "seq").dropDuplicates(["digest"])
    named = refs.filter("seq IS NOT NULL").select("ref_id", F.col("seq").alias("ref_seq"))
    if known is None:
        pairs = pair_all(named, unique)
    else:
        wanted = pair_all(named.select("ref_id"), unique.select("digest")).join(known, ["digest", "ref_id"], "left_anti")
        pairs = wanted.join(unique, "digest").join(maybe_broadcast(named), "ref_id")
    spread = pairs.repartition("digest", "ref_id")
    return spread.mapInPandas(_align_batches, "digest string, ref_id string, aligned string, aligned_ref string, score long")


def reuse_alignments(seqs: DataFrame, refs: DataFrame, store: DataFrame) -> DataFrame:
    """Stored alignments of the pairs asked for, fresh ones for each pair that the store lacks.

    A text that was aligned to some references is aligned to the others only. A pair stored twice comes once.
    """
    digests = seqs.select(F.md5("seq").alias("digest")).distinct()
    kept = store.join(digests, "digest", "left_semi").join(
        maybe_broadcast(refs.filter("seq IS NOT NULL").select("ref_id").distinct()), "ref_id", "left_semi")
    kept = kept.dropDuplicates(["digest", "ref_id"]).select("digest", "ref_id", "aligned", "aligned_ref", "score")
    return kept.unionByName(align_to_refs(seqs, refs, store.select("digest", "ref_id")))


def to_pileup(alignments: DataFrame, seqs: DataFrame) -> DataFrame:
    """Reference columns of each sequence: (ref_id, seq_id, ref_pos, base, ref_base, is_match)."""
    named = seqs.select("seq_id", F.md5("seq").alias("digest")).join(alignments, "digest")
    columns = F.arrays_zip(F.split("aligned", "").alias("base"), F.split("aligned_ref", "").alias("ref_base"))
    kept = F.filter(columns, lambda x: ~x["ref_base"].isin("-", ""))
    rows = named.select("ref_id", "seq_id", F.posexplode(kept).alias("ref_pos", "x"))
    return rows.select("ref_id", "seq_id", "ref_pos", F.col("x.base").alias("base"), F.col("x.ref_base").alias("ref_base"),
                       (F.col("x.base") == F.col("x.ref_base")).alias("is_match"))
