"""Motif and pattern search over sequences.

Sequences are ``(seq_id, seq)`` rows, motifs ``(name, regex)`` pairs (a Python list
or a DataFrame). Positions are 0-based and half-open. Bounded patterns are scanned
in overlapping pieces of a sequence, so one long sequence spreads over many rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.functions.scalars import (
    MARK, chunks, java_pattern, mark_places, match_count, mismatch_neighbours, orientations, overlap_hits, plain_hits, start_marks,
)
from strandframe.operators.joins import nearest_join, pair_all, range_join
from strandframe.operators.ordered import union_all
from strandframe.session import maybe_broadcast

STEP = 2048
_WIDE = 1024

Motifs = Iterable[tuple[str, str]] | DataFrame


def pattern_width(pattern: str) -> int | None:
    """Longest possible match, or None when it has no bound or looks around itself."""
    parsed = re._parser.parse(pattern)
    ops = str(parsed)
    if any(op in ops for op in ("AT,", "AT_", "ASSERT")):
        return None
    width = int(parsed.getwidth()[1])
    return width if width <= _WIDE else None


def _ids(seqs: DataFrame, seq: str) -> list[str]:
    return [c for c in seqs.columns if c != seq]


def _hits(expr: Column, keep: list[str], offset: Column) -> list[Column]:
    return [*[F.col(c) for c in keep], F.col("motif"), (offset + expr["start"]).cast("int").alias("start"),
            (offset + expr["start"] + F.length(expr["text"])).cast("int").alias("end"), expr["text"].alias("match")]


def scan_motifs(seqs: DataFrame, motifs: Motifs, overlap: bool = True, ignore_case: bool = False,
                seq: str = "seq") -> DataFrame:
    """All hits of every motif: (ids…, motif, start, end, match)."""
    finder = overlap_hits if overlap else plain_hits
    keep = _ids(seqs, seq)
    if isinstance(motifs, DataFrame):
        paired = pair_all(motifs.select(F.col("name").alias("motif"), "regex"), seqs)
        found = paired.select(*keep, "motif", F.explode(finder(seq, F.col("regex"), ignore_case)).alias("h"))
        return found.select(*_hits(F.col("h"), keep, F.lit(0)))

    parts = []
    motifs = list(motifs)
    widths = {name: pattern_width(regex) if overlap else None for name, regex in motifs}
    bounded = [(n, r) for n, r in motifs if widths[n]]
    whole = [(n, r) for n, r in motifs if not widths[n]]
    if bounded:
        context = max(widths[n] for n, _ in bounded)
        rows = seqs.select(*keep, F.posexplode(chunks(seq, STEP, context)).alias("_part", "_text"))
        marked = F.array(*[
            F.struct(F.lit(n).alias("motif"), start_marks("_text", r, ignore_case).alias("_marks"), F.lit(java_pattern(f"^(?:{r})", ignore_case)).alias("_re"))
            for n, r in bounded
        ])
        rows = rows.select(*keep, "_part", "_text", F.inline(marked))
        rows = rows.filter(F.contains("_marks", F.lit(MARK)))
        rows = rows.select(*keep, "_part", "_text", "motif", "_re", F.explode(mark_places(F.col("_marks"))).alias("_at")).filter(F.col("_at") < STEP)
        match = F.expr(f"regexp_extract(substring(_text, _at + 1, {context}), _re, 0)")
        start = F.col("_part") * STEP + F.col("_at")
        rows = rows.select(*keep, "motif", start.cast("int").alias("start"), match.alias("match"))
        parts.append(rows.select(*keep, "motif", "start", (F.col("start") + F.length("match")).cast("int").alias("end"), "match"))
    if whole:
        found = F.array(*[F.struct(F.lit(n).alias("motif"), finder(seq, r, ignore_case).alias("hits")) for n, r in whole])
        rows = seqs.select(*keep, F.inline(found)).select(*keep, "motif", F.explode("hits").alias("h"))
        parts.append(rows.select(*_hits(F.col("h"), keep, F.lit(0))))
    return union_all(parts)


def motif_count(seqs: DataFrame, motifs: Iterable[tuple[str, str]], lo: int | None = None, hi: int | None = None,
                ignore_case: bool = False, seq: str = "seq") -> DataFrame:
    """Hits and presence of each motif per sequence, zeros included.

    With ``lo``/``hi`` only starts in the closed range count. A bounded pattern is then looked for in the range
    and as many letters behind it as a match can have, the others in the whole text.
    """
    keep = _ids(seqs, seq)
    if lo is None and hi is None:
        per = [(n, match_count(seq, r, ignore_case)) for n, r in motifs]
    else:
        lo, hi = lo or 0, 2**31 - 1 if hi is None else hi
        first, size = max(lo, 0), hi - max(lo, 0) + 1

        def inside(r: str) -> Column:
            width = pattern_width(r)
            if not width or re._parser.parse(r).getwidth()[0] < 1:
                return F.size(F.filter(overlap_hits(seq, r, ignore_case), lambda h: h["start"].between(lo, hi)))
            text = F.substring(F.col(seq), first + 1, min(size + width - 1, 2**31 - 1))
            return F.regexp_count(F.substring(start_marks(text, r, ignore_case), 1, size), F.lit(MARK))

        per = [(n, inside(r)) for n, r in motifs]
    rows = F.array(*[F.struct(F.lit(n).alias("motif"), c.cast("long").alias("n_hits")) for n, c in per])
    return seqs.select(*keep, F.inline(rows)).withColumn("present", F.col("n_hits") > 0)


def motif_array(hits: DataFrame, lo: int, hi: int, seqs: DataFrame | None = None, motifs: Iterable[str] = ()) -> DataFrame:
    """0/1 array over the closed range of starts per (seq_id, motif).

    With ``seqs`` every sequence has an array for each of ``motifs``, else those with a hit in the range.
    """
    inside = hits.filter(F.col("start").between(lo, hi))
    starts = inside.groupBy("seq_id", "motif").agg(F.collect_set("start").alias("_starts"))
    if seqs is not None:
        names = F.array(*map(F.lit, motifs)).cast("array<string>")
        every = seqs.select("seq_id", F.explode(names).alias("motif"))
        starts = every.join(starts, ["seq_id", "motif"], "left").withColumn("_starts", F.coalesce("_starts", F.array().cast("array<int>")))
    flags = F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda p: F.array_contains("_starts", p).cast("int"))
    return starts.select("seq_id", "motif", flags.alias("presence"))


def add_motif(hits: DataFrame, seqs: DataFrame, name: str, regex: str) -> DataFrame:
    """Hits extended by one more motif; only the new motif is scanned."""
    return hits.unionByName(scan_motifs(seqs, [(name, regex)]))


class MotifFrame:
    """Read-only selections over one hit table (the iteration modes of a motif store)."""

    def __init__(self, seqs: DataFrame, motifs: list[tuple[str, str]]):
        self.seqs, self.motifs = seqs, list(motifs)
        self.hits = scan_motifs(seqs, self.motifs)

    def names(self) -> DataFrame:
        return self.seqs.sparkSession.createDataFrame(self.motifs, "motif string, regex string").select("motif")

    def sequences(self) -> DataFrame:
        return self.seqs

    def calls_of_sequence(self, seq_id) -> DataFrame:
        return self.hits.filter(F.col("seq_id") == seq_id)

    def calls_of_motif(self, motif: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        return _in_range(self.hits.filter(F.col("motif") == motif), lo, hi)

    def counts(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        return motif_count(self.seqs, self.motifs, lo, hi)

    def counts_of_motif(self, motif: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        chosen = [(n, r) for n, r in self.motifs if n == motif]
        return motif_count(self.seqs, chosen, lo, hi)

    def motif_totals(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        return _in_range(self.hits, lo, hi).groupBy("motif").agg(F.count("*").alias("n_hits"))


def _in_range(hits: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    if lo is not None:
        hits = hits.filter(F.col("start") >= lo)
    if hi is not None:
        hits = hits.filter(F.col("start") <= hi)
    return hits


def placements(seqs: DataFrame, width: int, seq: str = "seq") -> DataFrame:
    """One row per placement of a ``width``-letter window: (ids…, start, _letters, _s).

    The letters of the piece stay in the row as an array and ``_s`` is the place in it, so a
    score over them compiles to plain array reads.
    """
    keep = _ids(seqs, seq)
    pieces = seqs.select(*keep, F.posexplode(chunks(seq, STEP, width - 1)).alias("_part", "_text"))
    letters = pieces.select(*keep, "_part", F.split("_text", "").alias("_letters"))
    last = F.least(F.lit(STEP), F.size("_letters") - width + 1)
    rows = letters.select(*keep, "_part", "_letters", F.explode(F.when(last >= 1, F.sequence(F.lit(0), last - 1))).alias("_s"))
    return rows.withColumn("start", (F.col("_part") * STEP + F.col("_s")).cast("int")).drop("_part")


def _class_letters(pattern: str) -> list[str]:
    """Letters allowed at each position of a fixed-width class pattern ('A[CG].')."""
    out = []
    for m in re.finditer(r"\[([^\]]*)\]|(.)", pattern):
        out.append(m.group(1) if m.group(1) is not None else m.group(2))
    return out


def _mismatches(classes: list[str]) -> Column:
    total = F.lit(0)
    for j, allowed in enumerate(classes):
        if allowed != ".":
            total = total + (~F.get("_letters", F.col("_s") + j).isin(*allowed)).cast("int")
    return total


def _word(width: int) -> Column:
    return F.concat(*[F.get("_letters", F.col("_s") + j) for j in range(width)])


def fuzzy_scan(seqs: DataFrame, pattern: str, k: int, both_strands: bool = True, seq: str = "seq") -> DataFrame:
    """Placements of a class pattern with at most ``k`` mismatches in four orientations.

    ``to_end`` is the distance of the hit to the end of the original sequence.
    """
    classes = _class_letters(pattern)
    frame = seqs.withColumn("_len", F.length(seq))
    frame = orientations(frame, seq) if both_strands else frame.withColumn("orientation", F.lit("forward"))
    keep = [c for c in frame.columns if c not in (seq, "_len")]
    rows = placements(frame, len(classes), seq).withColumn("mismatches", _mismatches(classes)).filter(F.col("mismatches") <= k)
    flipped = F.col("orientation").isin("reverse", "reverse_complement")
    return rows.select(
        *keep, "start", "mismatches", _word(len(classes)).alias("match"),
        F.when(flipped, F.col("start")).otherwise(F.col("_len") - F.col("start")).cast("int").alias("to_end"))


def closest_match(seqs: DataFrame, query: str, both_strands: bool = True, seq: str = "seq") -> DataFrame:
    """Placements of ``query`` with the fewest mismatches per sequence and orientation, ties kept."""
    classes = list(query)
    frame = orientations(seqs, seq) if both_strands else seqs.withColumn("orientation", F.lit("forward"))
    keep = [c for c in frame.columns if c != seq]
    pieces = frame.select(*keep, F.posexplode(chunks(seq, STEP, len(classes) - 1)).alias("_part", "_text"))
    # a piece lets out its own best placements only, so few are ranked
    best = pieces.select(*keep, "_part", "_text", _best_places(classes)("_text").alias("_b")).select(
        *keep, "_part", "_text", F.col("_b.mismatches").alias("mismatches"), F.explode("_b.places").alias("_s"))
    rows = best.select(*keep, (F.col("_part") * STEP + F.col("_s")).cast("int").alias("start"), "mismatches",
                       F.substring("_text", F.col("_s") + 1, F.lit(len(classes))).alias("match"))
    w = Window.partitionBy(*keep).orderBy("mismatches")
    return rows.withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank")


def _best_places(classes: list[str]):
    """Fewest mismatches of a piece's placements and the places that have them."""
    allowed = [None if c == "." else [ord(x) for x in c] for c in classes]
    width = len(classes)

    def of(texts: pd.Series) -> pd.DataFrame:
        fewest, places = [], []
        for text in texts:
            letters = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
            n = min(STEP, len(letters) - width + 1)
            total = np.zeros(max(n, 0), np.int32)
            for j, ok in enumerate(allowed):
                if ok is not None and n > 0:
                    total += np.logical_and.reduce([letters[j:j + n] != x for x in ok])
            fewest.append(int(total.min(initial=width)))
            places.append(np.flatnonzero(total == fewest[-1]).astype(np.int32))
        return pd.DataFrame({"mismatches": pd.array(fewest, "Int32"), "places": places})

    return F.pandas_udf(of, "mismatches int, places array<int>")


def first_pos(seqs: DataFrame, patterns: list[str] | DataFrame, seq: str = "seq") -> DataFrame:
    """1-based first position of each literal pattern, 0 when absent."""
    keep = _ids(seqs, seq)
    if isinstance(patterns, DataFrame):
        paired = pair_all(patterns.select("pattern"), seqs)
        return paired.select(*keep, "pattern", F.instr(F.col(seq), F.col("pattern")).alias("position"))
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.instr(F.col(seq), F.lit(p)).alias("position")) for p in patterns])
    return seqs.select(*keep, F.inline(rows))


def neighbour_search(seqs: DataFrame, query: str, k: int = 1, alphabet: str = "ACGT", seq: str = "seq") -> DataFrame:
    """Where the ≤k-substitution neighbours of ``query`` occur exactly."""
    spark = seqs.sparkSession
    words = mismatch_neighbours(spark.createDataFrame([(query,)], "seq string"), k, "seq", alphabet)
    placed = first_pos(seqs, words.select(F.col("neighbour").alias("pattern")), seq)
    return placed.filter(F.col("position") > 0)


def call_sites(seqs: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, seq: str = "seq") -> DataFrame:
    """First wild-type or mutant match of each rule ``(rule, wild, mutant)``, its start and end; wild type wins."""
    keep = _ids(seqs, seq)
    if isinstance(rules, DataFrame):
        paired = pair_all(rules.select("rule", "wild", "mutant"), seqs)
    else:
        table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(w).alias("wild"), F.lit(m).alias("mutant")) for r, w, m in rules])
        paired = seqs.select("*", F.inline(table))
    wt = F.regexp_instr(seq, F.col("wild")) - 1
    mut = F.regexp_instr(seq, F.col("mutant")) - 1
    length = lambda pattern: F.length(F.call_function("regexp_extract", F.col(seq), F.col(pattern), F.lit(0)))
    called = paired.select(
        *keep, "rule",
        F.when(wt >= 0, wt).when(mut >= 0, mut).alias("start"),
        F.when(wt >= 0, wt + length("wild")).when(mut >= 0, mut + length("mutant")).alias("end"),
        F.when(wt >= 0, F.lit(True)).when(mut >= 0, F.lit(False)).alias("is_wild"),
    )
    return called.filter(F.col("start").isNotNull())


def containment(seqs: DataFrame, probes: list[str], seq: str = "seq") -> DataFrame:
    """Number and share of sequences that contain each probe."""
    rows = F.array(*[F.struct(F.lit(p).alias("probe"), F.contains(F.col(seq), F.lit(p)).cast("int").alias("_in")) for p in probes])
    return seqs.select(F.inline(rows)).groupBy("probe").agg(
        F.sum("_in").alias("n_with"), F.avg("_in").alias("share"))


def find_islands(seqs: DataFrame, islands: list[tuple[str, str]], seq: str = "seq") -> DataFrame:
    """All occurrences, overlaps included, of known literal islands."""
    return scan_motifs(seqs, [(n, re.escape(s)) for n, s in islands], seq=seq)


def kmer_index(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Every k-letter word with its place: (ids…, start, kmer)."""
    keep = _ids(seqs, seq)
    pieces = seqs.select(*keep, F.posexplode(chunks(seq, STEP, k - 1)).alias("_part", "_text"))
    words = F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    rows = pieces.select(*keep, "_part", F.posexplode(words).alias("_at", "kmer")).filter(F.col("_at") < STEP)
    return rows.select(*keep, (F.col("_part") * STEP + F.col("_at")).cast("int").alias("start"), "kmer")


def kmer_lookup(index: DataFrame, queries: DataFrame, mismatches: int = 0, alphabet: str = "ACGT") -> DataFrame:
    """Places of each query word ``(query)`` at up to ``mismatches`` substitutions."""
    words = mismatch_neighbours(queries.select("query", F.col("query").alias("seq")), mismatches, "seq", alphabet)
    words = words.select("query", F.col("neighbour").alias("kmer"), F.size("changed").alias("mismatches"))
    return index.join(maybe_broadcast(words), "kmer")


def nearest_site(positions: DataFrame, sites: DataFrame, tol: int, on: str = "chrom") -> DataFrame:
    """Nearest site of each position within ``tol`` and its signed distance."""
    return nearest_join(positions, sites, [on], tol)


def best_hit(hits: DataFrame, cut: float = 0.01) -> DataFrame:
    """Smallest p-value per (seq_id, name) and presence at ``p < cut``."""
    low = hits.groupBy("seq_id", "name").agg(F.min("p_val").alias("p_val"))
    return low.withColumn("present", F.col("p_val") < cut)


FEATURE_COLUMNS = ["seq_id", "type", "name", "start", "end", "p_val", "hom", "is_wild"]


def annotate(*, motif_hits: DataFrame | None = None, site_calls: DataFrame | None = None,
             island_hits: DataFrame | None = None, mirna_hits: DataFrame | None = None,
             existing: DataFrame | None = None, force: set[str] | None = None) -> DataFrame:
    """One feature table from all annotation sources.

    Types already in ``existing`` are kept unless named in ``force``.
    """
    null = F.lit(None)
    parts = []

    def shape(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        base = {"type": F.lit(kind), "p_val": null.cast("double"), "hom": null.cast("double"), "is_wild": null.cast("boolean")}
        base.update(columns)
        return df.select("seq_id", *[v.alias(n) for n, v in base.items()]).select(*FEATURE_COLUMNS)

    se = {"start": F.col("start").cast("int"), "end": F.col("end").cast("int")}
    if motif_hits is not None:
        parts.append(shape(motif_hits, "ELM", name=F.col("motif"), **se))
    if site_calls is not None:
        parts.append(shape(site_calls, "ResistSite", name=F.col("rule"), is_wild=F.col("is_wild"), **se))
    if island_hits is not None:
        parts.append(shape(island_hits, "HomIsland", name=F.col("motif"), **se))
    if mirna_hits is not None:
        parts.append(shape(mirna_hits, "MIRNA", name=F.col("name"), p_val=F.col("p_val"), **se))
    fresh = union_all(parts) if parts else None
    if existing is None:
        return fresh
    forced = list(force or ())
    kept = existing.filter(~F.col("type").isin(*forced)) if forced else existing
    if fresh is None:
        return kept
    done = kept.select("type").distinct()
    return kept.unionByName(fresh.join(F.broadcast(done), "type", "left_anti").select(*FEATURE_COLUMNS))


def rollup_calls(calls: DataFrame, key: str = "pat") -> DataFrame:
    """Per-fragment calls combined per patient: OR of flags, maximum of values."""
    return calls.groupBy(key, "feature").agg(F.max("value").alias("value"))


def binned_presence(hits: DataFrame, bins: DataFrame, closed: str = "left") -> DataFrame:
    """Presence of each (motif, bin) per sequence that has any hit in it."""
    placed = range_join(hits, bins, ["motif"], "start", "lo", "hi", closed=closed)
    return placed.groupBy("seq_id", "motif", "bin_id").agg(F.count("*").alias("n_hits"))
