"""Aligned columns packed into pieces: a row holds SPAN columns of one sequence on one reference as two texts.

Rows are ``(ref_id, seq_id, first, base, ref_base)``: the number of the first column and the letters of the sequence
and of the reference, each piece followed by two letters of the next one so that a codon is always whole in the row
it begins in. Only match runs, called sites and changed codons become rows of their own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.functions.scalars import chunks, translate_codons
from strandframe.operators.joins import pair_all
from strandframe.operators.ordered import ordered_scan, union_all
from strandframe.session import cut_lineage, maybe_broadcast

#: Columns of a piece, and letters of the next piece that follow them.
SPAN, AHEAD = 4096, 2
KEYS = ["ref_id", "seq_id"]
#: Letters that have an upper case here: the others stay, so that each column stays one letter.
CASES = (string.ascii_lowercase, string.ascii_uppercase)


def pack_sequences(seqs: DataFrame, refs: DataFrame) -> DataFrame:
    """Sequences laid letter by letter on each of ``refs(ref_id, seq)``; past a reference's end its letter is '-'."""
    def pieces(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[c for c in df.columns if c != "seq"], F.posexplode(chunks("seq", SPAN, AHEAD)).alias("_part", name))

    mine = pieces(seqs.select("seq_id", "seq"), "base")
    mine = pair_all(refs.filter("seq IS NOT NULL").select("ref_id").distinct(), mine)
    theirs = pieces(refs.select("ref_id", "seq"), "ref_base")
    size = F.length("base")
    on_ref = F.rpad(F.substring(F.coalesce("ref_base", F.lit("")), F.lit(1), size), size, F.lit("-"))
    return mine.join(maybe_broadcast(theirs), ["ref_id", "_part"], "left").select(
        "ref_id", "seq_id", (F.col("_part") * SPAN).alias("first"), "base", on_ref.alias("ref_base"))


def pack_alignments(alignments: DataFrame, seqs: DataFrame) -> DataFrame:
    """Columns of the reference out of aligned texts; letters between two columns of the reference are left out."""
    columns = F.arrays_zip(F.split("aligned", "").alias("b"), F.split("aligned_ref", "").alias("r"))
    kept = alignments.select("digest", "ref_id", F.filter(columns, lambda x: ~x["r"].isin("-", "")).alias("_c")).filter("size(_c) > 0")
    starts = F.sequence(F.lit(0), F.size("_c") - 1, F.lit(SPAN))

    def piece(at: Column) -> Column:
        cells = F.slice("_c", at + 1, SPAN + AHEAD)
        return F.struct(at.alias("first"), F.array_join(cells["b"], "").alias("base"), F.array_join(cells["r"], "").alias("ref_base"))

    rows = kept.select("digest", "ref_id", F.inline(F.transform(starts, piece)))
    named = seqs.filter("seq IS NOT NULL").select("seq_id", F.md5("seq").alias("digest"))
    return rows.join(named, "digest").select("ref_id", "seq_id", "first", "base", "ref_base")


def _own() -> Column:
    return F.least(F.length("base"), F.lit(SPAN))


def fragments(packed: DataFrame) -> DataFrame:
    """First and last column with a letter of the sequence: (ref_id, seq_id, first_pos, last_pos). None: no row."""
    mine = F.substring(F.col("base"), F.lit(1), _own())
    lead, trail = F.regexp_instr(mine, F.lit("[A-Za-z]")), F.regexp_instr(F.reverse(mine), F.lit("[A-Za-z]"))
    return packed.filter(lead > 0).groupBy(*KEYS).agg(
        F.min(F.col("first") + lead - 1).alias("first_pos"), F.max(F.col("first") + _own() - trail).alias("last_pos"))


def match_runs(packed: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Longest stretches of equal letters, ``[start, end)`` in columns; with ``bounds`` inside the fragments only.

    Runs are found inside a piece. Those that touch an end of their piece, at most two for each, are
    joined with the run that goes on in the next one.
    """
    rows = packed.withColumns({"_lo": F.col("first"), "_hi": F.col("first") + _own()})
    if bounds is not None:
        rows = rows.join(bounds, KEYS).withColumns({"_lo": F.greatest("_lo", "first_pos"), "_hi": F.least("_hi", F.col("last_pos") + 1)})
    # where the sequence has no '-', nothing matches past the reference's last letter
    theirs = F.col("first") + F.length(F.rtrim("ref_base", F.lit("-")))
    rows = rows.withColumn("_hi", F.when(F.contains("base", F.lit("-")), F.col("_hi")).otherwise(F.least("_hi", theirs)))
    here = rows.filter("_lo < _hi").select(*KEYS, "_lo", "_hi", *[
        F.split(F.substring(F.col(c), F.col("_lo") - F.col("first") + 1, F.col("_hi") - F.col("_lo")), "").alias(c) for c in ("base", "ref_base")])
    differs = F.zip_with("base", "ref_base", lambda b, r: b != r)
    places = F.filter(F.transform(differs, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    breaks = here.select(*KEYS, "_lo", "_hi", F.concat(F.array(F.lit(-1)), places, F.array((F.col("_hi") - F.col("_lo")).cast("int"))).alias("_m"))
    runs = F.expr("filter(transform(sequence(1, size(_m) - 1), k -> struct(_lo + _m[k - 1] + 1 AS start, _lo + _m[k] AS end)), x -> x.end > x.start)")
    found = cut_lineage(breaks.select(*KEYS, "_lo", "_hi", F.inline(runs)))
    touches = (F.col("start") == F.col("_lo")) | (F.col("end") == F.col("_hi"))
    w = Window.partitionBy(*KEYS).orderBy("start")
    edge = found.filter(touches).withColumn("_new", F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1))
    joined = edge.withColumn("_run", F.sum("_new").over(w)).groupBy(*KEYS, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.filter(~touches).select(*KEYS, "start", "end").unionByName(joined.drop("_run"))


def run_summary(packed: DataFrame) -> DataFrame:
    """Columns, longest match run and summed run lengths of each sequence.

    From the columns of a run of n letters the run goes on for n, n - 1, ... 1 letters, in either direction.
    """
    length = F.col("end") - F.col("start")
    none = F.lit(0).cast("long")
    parts = packed.select(*KEYS, _own().cast("long").alias("n"), none.alias("longest"), none.alias("total")).unionByName(
        match_runs(packed).select(*KEYS, none.alias("n"), length.cast("long").alias("longest"), F.expr("(end - start) * (end - start + 1L) div 2").alias("total")))
    return parts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.max("longest").alias("longest"), F.sum("total").alias("total"))


def mismatch_gaps(packed: DataFrame) -> DataFrame:
    """Columns of each sequence with a mismatch at or behind them, and their summed distances to it: (ref_id, seq_id, n, total).

    Gaps inside a piece are summed there; of a piece only its first and last mismatch meet those of its neighbours.
    ``total`` is null for a sequence without a mismatch.
    """
    own = [F.split(F.substring(F.col(c), F.lit(1), _own()), "") for c in ("base", "ref_base")]
    marks = F.array_join(F.zip_with(*own, lambda b, r: F.when(b == r, ".").otherwise("x")), "")
    at = packed.select(*KEYS, "first", marks.alias("_m"))
    lead, trail = F.instr("_m", "x"), F.instr(F.reverse("_m"), "x")
    runs = F.regexp_extract_all("_m", F.lit("(?<=x)[.]+(?=x)"), F.lit(0))
    within = F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: s + F.floor(F.length(x) * (F.length(x) + 1) / 2))
    ends = at.select(*KEYS, "first", *[F.when(lead > 0, v).alias(c) for c, v in (
        ("_from", F.col("first") + lead - 1), ("_to", F.col("first") + F.length("_m") - trail), ("_in", within))])
    before = F.coalesce(F.max("_to").over(Window.partitionBy(*KEYS).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    gap = (F.col("_from") - before - 1).cast("long")
    each = ends.select(*KEYS, "_to", (F.col("_in") + F.floor(gap * (gap + 1) / 2)).alias("_sum"))
    return each.groupBy(*KEYS).agg(F.coalesce(F.max("_to") + 1, F.lit(0)).cast("long").alias("n"), F.sum("_sum").alias("total"))


def spans(packed: DataFrame) -> DataFrame:
    """First and last column of each piece, whatever stands there: the bounds under which every letter counts."""
    return packed.filter(_own() > 0).select(*KEYS, F.col("first").alias("first_pos"), (F.col("first") + _own() - 1).alias("last_pos"))


def change_points(bounds: DataFrame, runs: DataFrame | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """Sums over fragments and runs for stretches of columns: ``(ref_id, ref_pos, _to, _cover, ...)``.

    Of a column it counts how many fragments cover it (``_cover``) and sums each of ``counts`` over the runs that
    cover it: starts and ends are summed by column before they are shuffled, and columns without a start or end share
    the sums before them, up to ``_to``.
    """
    counts = counts or {}
    names = ["_cover", *counts]

    def events(df: DataFrame, start: str, stop: Column, values: dict[str, Column]) -> DataFrame:
        both = F.array(F.struct(F.col(start).cast("long").alias("ref_pos"), F.lit(1).alias("s")), F.struct(stop.cast("long").alias("ref_pos"), F.lit(-1).alias("s")))
        marked = df.select("ref_id", *[values.get(n, F.lit(0)).cast("long").alias(f"_v{n}") for n in names], F.inline(both))
        return marked.select("ref_id", "ref_pos", *[(F.col(f"_v{n}") * F.col("s")).alias(n) for n in names])

    every = events(bounds, "first_pos", F.col("last_pos") + 1, {"_cover": F.lit(1)})
    if runs is not None:
        every = every.unionByName(events(runs, "start", F.col("end"), counts))
    steps = cut_lineage(every.groupBy("ref_id", "ref_pos").agg(*[F.sum(c).alias(c) for c in names]))
    scanned = ordered_scan(steps, ["ref_id"], "ref_pos", [
        *[(f"_s{n}", "sum", F.col(n)) for n in names], ("_to", "next_after", F.col("ref_pos"))], SPAN)
    return scanned.filter("_s_cover > 0").select("ref_id", "ref_pos", "_to", *[F.col(f"_s{n}").alias(n) for n in names])


def snp_sites(runs: DataFrame, bounds: DataFrame, min_run: int = 30, run_share: float = 0.05, mismatch_share: float = 0.05) -> DataFrame:
    """Columns of each reference where enough sequences lie in long match runs and enough differ.

    As in the letter form the two lengths around a column count it twice, so n letters are n + 1.
    """
    counted = change_points(bounds, runs, {"_match": F.lit(1), "_long": F.col("end") - F.col("start") + 1 > min_run})
    shares = counted.select(
        "ref_id", "ref_pos", "_to", (F.col("_long") / F.col("_cover")).alias("run_share"), ((F.col("_cover") - F.col("_match")) / F.col("_cover")).alias("mismatch_share"))
    kept = shares.filter((F.col("run_share") > run_share) & (F.col("mismatch_share") > mismatch_share))
    return kept.select("ref_id", F.explode(F.sequence(F.col("ref_pos"), F.col("_to") - 1)).alias("ref_pos"), "run_share", "mismatch_share")


def log_mean_island(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """log2 of the mean forward run of each column that a run covers: (ref_id, ref_pos, log_run).

    Forward runs at a column are the ends of its runs less the column, so the sum of ends and the number of runs say their sum.
    """
    counted = change_points(bounds, runs, {"_match": F.lit(1), "_ends": F.col("end")}).filter("_match > 0")
    each = counted.select("ref_id", F.explode(F.sequence(F.col("ref_pos"), F.col("_to") - 1)).alias("ref_pos"), "_cover", "_match", "_ends")
    return each.select("ref_id", "ref_pos", F.log2((F.col("_ends") - F.col("ref_pos") * F.col("_match")) / F.col("_cover")).alias("log_run"))


def forward_counts(runs: DataFrame) -> DataFrame:
    """How many sequences have a match run of each length from each column on: (ref_id, ref_pos, forward, n).

    Equal runs are counted before their columns become rows, so rows grow with the different runs of a reference.
    """
    equal = cut_lineage(runs.groupBy("ref_id", "start", "end").agg(F.count("*").alias("n")))
    cells = equal.select("ref_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("ref_pos"), "end", "n")
    return cells.groupBy("ref_id", "ref_pos", (F.col("end") - F.col("ref_pos")).alias("forward")).agg(F.sum("n").alias("n"))


def long_run_counts(runs: DataFrame, min_len: int) -> DataFrame:
    """How many sequences have a match run of more than ``min_len`` letters from each column on: (ref_id, ref_pos, n); none: no row."""
    starts = runs.filter(F.col("end") - F.col("start") > min_len).select("ref_id", "start", (F.col("end") - min_len).alias("end"))
    covered = change_points(starts.select("ref_id", F.col("start").alias("first_pos"), (F.col("end") - 1).alias("last_pos")))
    return covered.select("ref_id", F.explode(F.sequence(F.col("ref_pos"), F.col("_to") - 1)).alias("ref_pos"), F.col("_cover").alias("n"))


def snps_per_sequence(packed: DataFrame, sites: DataFrame) -> DataFrame:
    """Differing letters of each sequence at the sites: (ref_id, seq_id, n_snps); none: no row."""
    at = F.col("_site") - F.col("first") + 1
    letter = lambda c: F.substring(F.col(c), at.cast("int"), F.lit(1))
    rows = packed.join(_by_piece(sites), ["ref_id", "first"]).select(*KEYS, "first", _own().alias("_n"), "base", "ref_base", F.explode("_sites").alias("_site"))
    hit = rows.filter((at <= F.col("_n")) & (letter("base") != letter("ref_base")))
    return hit.groupBy(*KEYS).agg(F.count("*").alias("n_snps"))


def _by_piece(sites: DataFrame) -> DataFrame:
    found = sites.select("ref_id", "ref_pos").distinct().groupBy("ref_id", (F.floor(F.col("ref_pos") / SPAN) * SPAN).alias("first")).agg(
        F.collect_list("ref_pos").alias("_sites"))  # at most SPAN
    return maybe_broadcast(cut_lineage(found))


def base_calls(packed: DataFrame, sites: DataFrame, bounds: DataFrame) -> DataFrame:
    """Letter of each sequence at each site of its reference, NULL outside its fragment: (ref_id, seq_id, ref_pos, base)."""
    own = F.filter("_sites", lambda p: p < F.col("first") + _own())
    letter = F.transform(own, lambda p: F.struct(p.alias("ref_pos"), F.substring(F.col("base"), (p - F.col("first") + 1).cast("int"), F.lit(1)).alias("base")))
    # only the letters at sites meet the fragments, not the pieces
    rows = packed.join(_by_piece(sites), ["ref_id", "first"]).select(*KEYS, letter.alias("_calls")).filter("size(_calls) > 0")
    at = rows.join(bounds, KEYS, "left").select(*KEYS, "first_pos", "last_pos", F.inline("_calls"))
    return at.select(*KEYS, "ref_pos", F.when(F.col("ref_pos").between(F.col("first_pos"), F.col("last_pos")), F.col("base")).alias("base"))


def classify_mutations(packed: DataFrame, genes: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Changed codons of ``genes(gene, start, end)`` inside the fragments: 0 silent, 1 mis-sense, 2 non-sense.

    A codon is judged in the piece it begins in; only changed ones leave it. Without ``bounds`` the columns count in
    which the reference has a letter, and a piece says so itself.
    """
    upper = packed.select(*KEYS, "first", *[F.translate(c, *CASES).alias(c) for c in ("base", "ref_base")])
    if bounds is None:
        known = F.length(F.rtrim("ref_base", F.lit("-")))
        upper = upper.withColumns({"first_pos": F.lit(0), "last_pos": F.col("first") + known - 1})
    reach = packed.agg(F.max("first")).first()[0]  # genes that begin behind the last piece meet none
    starts = F.sequence(F.floor(F.col("start") / SPAN) * SPAN, F.floor((F.col("end") - 1) / SPAN) * SPAN, F.lit(SPAN).cast("long"))
    placed = genes.filter((F.col("end") > F.col("start")) & (F.col("start") < F.lit(reach) + SPAN)).withColumn("first", F.explode(starts))
    rows = upper.join(maybe_broadcast(placed), "first")
    if bounds is not None:
        rows = rows.join(bounds, KEYS)
    rows = rows.withColumn("_lo", F.greatest("first", "first_pos", "start")).withColumn("_lo", F.expr("start + (_lo - start + 2) div 3 * 3"))
    rows = rows.withColumn("_hi", F.least(F.col("first") + _own() - 1, F.col("end") - 3, F.col("last_pos") - 2)).filter("_lo <= _hi")
    # the gene's part of a piece is cut out before its codons are
    cut = [F.substring(c, (F.col("_lo") - F.col("first") + 1).cast("int"), (F.col("_hi") - F.col("_lo") + 3).cast("int")).alias(c) for c in ("base", "ref_base")]
    rows = rows.select(*KEYS, "gene", "start", "_lo", "_hi", *cut)
    words = F.expr("""filter(transform(sequence(bigint(_lo), bigint(_hi), 3L), c -> struct((c - start) div 3 AS codon,
      substring(base, int(c - _lo) + 1, 3) AS codon_seq, substring(ref_base, int(c - _lo) + 1, 3) AS codon_ref)), x -> x.codon_seq <> x.codon_ref)""")
    changed = rows.select(*KEYS, "gene", F.inline(words))
    changed = changed.withColumns({"aa": translate_codons("codon_seq", False), "ref_aa": translate_codons("codon_ref", False)})
    kind = F.when(F.col("aa") == F.col("ref_aa"), 0).when((F.col("aa") == "*") | (F.col("ref_aa") == "*"), 2).otherwise(1)
    return changed.withColumn("mutation_class", kind)
