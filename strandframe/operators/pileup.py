"""Aligned columns ``(seq_id, ref_pos, base, ref_base, is_match)``: variants, runs, islands, profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandframe.functions.scalars import chunks, translate_codons
from strandframe.operators.joins import range_join
from strandframe.operators.ordered import ordered_scan
from strandframe.session import cut_lineage, maybe_broadcast

#: Columns of one sequence that are scanned together.
SPAN = 4096


def _letters(seqs: DataFrame, seq: str) -> DataFrame:
    keep = [c for c in seqs.columns if c != seq]
    parts = seqs.select(*keep, F.posexplode(chunks(seq, SPAN, 0)).alias("_part", "_text"))
    rows = parts.select(*keep, "_part", F.posexplode(F.split("_text", "")).alias("_at", "base"))
    return rows.select(*keep, (F.col("_part") * SPAN + F.col("_at")).cast("int").alias("ref_pos"), "base")


def trivial_pileup(seqs: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """Sequences laid letter by letter on one reference (by default the one with the lowest id).

    Every letter of every sequence has a row; past the end of the reference its letter is '-'.
    """
    if ref is None:
        ref = seqs.groupBy().agg(F.min(F.struct("seq_id", "seq")).alias("r")).select("r.seq")
    columns = _letters(ref.select("seq"), "seq").withColumnRenamed("base", "ref_base")
    rows = _letters(seqs, "seq").join(maybe_broadcast(columns), "ref_pos", "left").withColumn("ref_base", F.coalesce("ref_base", F.lit("-")))
    return rows.select("seq_id", "ref_pos", "base", "ref_base", (F.col("base") == F.col("ref_base")).alias("is_match"))


def mismatches(pileup: DataFrame) -> DataFrame:
    return pileup.withColumn("mismatch", F.col("base") != F.col("ref_base"))


def fragment_bounds(pileup: DataFrame, keys: list[str] = ["seq_id"]) -> DataFrame:
    """First and last column where a sequence has a letter."""
    letter = F.when(F.col("base").rlike("^[A-Za-z]$"), F.col("ref_pos"))
    return pileup.groupBy(*keys).agg(F.min(letter).alias("first_pos"), F.max(letter).alias("last_pos"))


def mask_fragments(pileup: DataFrame, keys: list[str] = ["seq_id"]) -> DataFrame:
    """Bases and match flags outside the sequenced fragment set to NULL."""
    inside = F.col("ref_pos").between(F.col("first_pos"), F.col("last_pos"))
    out = pileup.join(fragment_bounds(pileup, keys), keys)
    return out.withColumns({c: F.when(inside, F.col(c)) for c in ("base", "is_match")}).drop("first_pos", "last_pos")


def mask_counts(seqs: DataFrame) -> DataFrame:
    """Columns of each sequence and those inside its fragment (seq_id, n, n_inside), as ``mask_fragments`` leaves them.

    Rows of one id share a fragment. An empty text is one column without a letter.
    """
    size, lead, trail = F.length("seq"), F.regexp_instr("seq", F.lit("[A-Za-z]")), F.regexp_instr(F.reverse("seq"), F.lit("[A-Za-z]"))
    facts = seqs.filter("seq_id IS NOT NULL AND seq IS NOT NULL").select(
        "seq_id", F.greatest(size, F.lit(1)).alias("size"), F.when(lead > 0, lead).alias("lo"), F.when(lead > 0, size - trail + 1).alias("hi"))
    sizes = facts.groupBy("seq_id", "size").agg(F.count("*").alias("_n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    w = Window.partitionBy("seq_id")  # at most the different sizes of an id
    inside = F.greatest(F.least(F.max("hi").over(w), "size") - F.min("lo").over(w) + 1, F.lit(0))
    each = sizes.select("seq_id", (F.col("_n") * F.col("size")).alias("n"), (F.col("_n") * F.coalesce(inside, F.lit(0))).alias("n_inside"))
    return each.groupBy("seq_id").agg(F.sum("n").alias("n"), F.sum("n_inside").alias("n_inside"))


def run_lengths(pileup: DataFrame, keys: list[str] = ["seq_id"], span: int = SPAN) -> DataFrame:
    """Length of the match run from each column to its end (forward) and from its start (backward)."""
    pos = F.col("ref_pos")
    broken = F.when(~F.coalesce("is_match", F.lit(False)), pos)
    ends = pileup.groupBy(*keys).agg(F.min("ref_pos").alias("_lo"), F.max("ref_pos").alias("_hi"))
    scanned = ordered_scan(pileup, keys, "ref_pos", [("_prev", "last", broken), ("_next", "next", broken)], span).join(ends, keys)
    return scanned.withColumn("forward", F.coalesce("_next", F.col("_hi") + 1) - pos).withColumn(
        "backward", pos - F.coalesce("_prev", F.col("_lo") - 1)).drop("_prev", "_next", "_lo", "_hi")


def distance_to_next(pileup: DataFrame, keys: list[str] = ["seq_id"], span: int = SPAN) -> DataFrame:
    """Columns until the next mismatch (0 on a mismatch, NULL after the last)."""
    broken = F.when(~F.col("is_match"), F.col("ref_pos"))
    out = ordered_scan(pileup, keys, "ref_pos", [("_next", "next", broken)], span)
    return out.withColumn("to_next", F.col("_next") - F.col("ref_pos")).drop("_next")


def snp_sites(runs: DataFrame, min_run: int = 30, run_share: float = 0.05, mismatch_share: float = 0.05,
              hidden: DataFrame | None = None) -> DataFrame:
    """Columns where enough sequences lie in long match runs and enough differ.

    The run around a column is its forward and backward length together; sequences without a letter
    there (``is_match`` NULL or no row) do not count.
    """
    if hidden is not None:
        runs = runs.join(hidden, "seq_id", "left_anti")
    stats = runs.filter("is_match IS NOT NULL").groupBy("ref_pos").agg(
        F.avg((F.col("forward") + F.col("backward") > min_run).cast("double")).alias("run_share"),
        F.avg((~F.col("is_match")).cast("double")).alias("mismatch_share"))
    return stats.filter((F.col("run_share") > run_share) & (F.col("mismatch_share") > mismatch_share))


def base_calls(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """Base of each sequence at the sites, NULL outside its fragment (long form)."""
    return mask_fragments(pileup).join(sites.select("ref_pos").distinct(), "ref_pos").select("seq_id", "ref_pos", "base")


def base_call_matrix(calls: DataFrame, positions: list[int]) -> DataFrame:
    """Wide form: one column per site."""
    return calls.groupBy("seq_id").pivot("ref_pos", positions).agg(F.first("base"))


def classify_mutations(pileup: DataFrame, genes: DataFrame) -> DataFrame:
    """Changed codons: 0 silent, 1 mis-sense, 2 non-sense (a stop appears or the last one is lost).

    ``genes(gene, start, end)`` in reference columns.
    """
    placed = range_join(pileup.withColumn("_one", F.lit(0)), genes.withColumn("_one", F.lit(0)), ["_one"], "ref_pos", "start", "end")
    placed = placed.withColumn("codon", F.floor((F.col("ref_pos") - F.col("start")) / 3)).withColumn("_in", (F.col("ref_pos") - F.col("start")) % 3)

    def word(col: str):
        return F.upper(F.concat(*[F.max(F.when(F.col("_in") == i, F.col(col))) for i in range(3)]))

    codons = placed.groupBy("seq_id", "gene", "codon").agg(word("base").alias("codon_seq"), word("ref_base").alias("codon_ref"))
    aa, ref_aa = translate_codons("codon_seq", False), translate_codons("codon_ref", False)
    changed = codons.filter("codon_seq <> codon_ref").withColumns({"aa": aa, "ref_aa": ref_aa})
    kind = F.when(F.col("aa") == F.col("ref_aa"), 0).when((F.col("aa") == "*") | (F.col("ref_aa") == "*"), 2).otherwise(1)
    return changed.withColumn("mutation_class", kind)


def homology_profile(pileup: DataFrame, keys: list[str] = [], every: int = 2) -> DataFrame:
    """Share of all sequences that match, per column, every second column.

    A sequence that does not reach a column does not match there.
    """
    matches = pileup.filter(F.col("ref_pos") % every == 0).groupBy(*keys, "ref_pos").agg(F.sum(F.coalesce(F.col("is_match").cast("long"), F.lit(0))).alias("_m"))
    return _share_of_all(matches, pileup, keys, "_m").withColumnRenamed("_share", "homology").drop("_m")


def _share_of_all(counts: DataFrame, rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Adds ``_share``: ``count`` divided by the number of all sequences (of the same keys)."""
    if not keys:
        return counts.withColumn("_share", F.col(count) / F.lit(rows.select("seq_id").distinct().count()))
    everyone = rows.select(*keys, "seq_id").distinct().groupBy(*keys).agg(F.count("*").alias("_everyone"))
    return counts.join(everyone, keys).withColumn("_share", F.col(count) / F.col("_everyone")).drop("_everyone")


def sliding_similarity(profile: DataFrame, width: int = 26, keys: list[str] = [], value: str = "homology", span: int = SPAN,
                       spacing: int = 1) -> DataFrame:
    """Mean of the next ``width`` rows from each column on.

    ``profile`` has one row every ``spacing`` reference columns. Rows are placed into the block of
    columns they start in and, when near its beginning, into the block before as well.
    """
    step = F.floor(F.col("ref_pos") / span)
    reach = F.array_distinct(F.array(step, F.floor((F.col("ref_pos") - (width - 1) * spacing) / span)))
    rows = profile.withColumn("_block", F.explode(reach))
    w = Window.partitionBy(*keys, "_block").orderBy("ref_pos").rowsBetween(0, width - 1)
    return rows.withColumn("similarity", F.avg(value).over(w)).filter(F.col("_block") == step).drop("_block")


def islands(runs: DataFrame, min_size: int, min_hom: float, keys: list[str] = ["ref_id"]) -> DataFrame:
    """Conserved islands: from each column the longest stretch that enough of all sequences still match,
    taken left to right without overlap.

    Stretches that overlap form a cluster; clusters do not influence each other, so the
    left-to-right pass runs per cluster.
    """
    return islands_of_counts(runs.groupBy(*keys, "ref_pos", "forward").agg(F.count("*").alias("n")), runs, min_size, min_hom, keys)


def islands_of_counts(lengths: DataFrame, seqs: DataFrame, min_size: int, min_hom: float, keys: list[str] = ["ref_id"]) -> DataFrame:
    """``islands`` from the number ``n`` of sequences by column and forward run; ``seqs`` has all sequences by key."""
    w = Window.partitionBy(*keys, "ref_pos").orderBy(F.desc("forward")).rowsBetween(Window.unboundedPreceding, 0)
    share = _share_of_all(lengths.withColumn("_cum", F.sum("n").over(w)), seqs, keys, "_cum")
    best = share.filter((F.col("_share") >= min_hom) & (F.col("forward") >= min_size)).groupBy(
        *keys, "ref_pos").agg(F.max("forward").alias("length"))
    ends = best.withColumn("_end", F.col("ref_pos") + F.col("length"))
    seen = ordered_scan(ends, keys, "ref_pos", [("_seen", "max_before", F.col("_end"))], SPAN)
    fresh = seen.withColumn("_new", F.when(F.coalesce(F.col("ref_pos") >= F.col("_seen"), F.lit(True)), 1).otherwise(0))
    grouped = ordered_scan(fresh, keys, "ref_pos", [("_cluster", "sum", F.col("_new"))], SPAN)

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ref_pos")
        keep, free = [], -1
        for pos, length in zip(pdf["ref_pos"], pdf["length"]):
            keep.append(pos >= free)
            if pos >= free:
                free = pos + length
        return pdf[keep]

    columns = [*keys, "_cluster", "ref_pos", "length"]
    picked = grouped.select(*columns)
    out = picked.groupBy(*keys, "_cluster").applyInPandas(sweep, picked.schema)
    return out.select(*keys, F.col("ref_pos").alias("start"), (F.col("ref_pos") + F.col("length")).alias("end"))


def islands_multi(runs: DataFrame, min_len: int, cuts: list[float], keys: list[str] = ["ref_id"]) -> DataFrame:
    """Stretches of columns where the share of all sequences in runs longer than ``min_len`` reaches each cut-off."""
    counts = runs.groupBy(*keys, "ref_pos").agg(F.sum((F.col("forward") > min_len).cast("long")).alias("n"))
    return islands_multi_of_counts(counts, runs, min_len, cuts, keys)


def islands_multi_of_counts(counts: DataFrame, seqs: DataFrame, min_len: int, cuts: list[float], keys: list[str] = ["ref_id"]) -> DataFrame:
    """``islands_multi`` from the number ``n`` of sequences in longer runs by column; ``seqs`` has all sequences by key."""
    share = _share_of_all(counts, seqs, keys, "n")
    rows = share.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cuts]))).filter("_share >= cutoff")
    spans = rows.select(*keys, "cutoff", F.col("ref_pos").alias("start"), (F.col("ref_pos") + 1).alias("end"))
    from strandframe.operators.features import merge_intervals
    merged = merge_intervals(spans, [*keys, "cutoff"])
    # a run of length > min_len that starts inside reaches min_len columns further
    return merged.withColumn("end", F.col("end") + min_len)


def confirm_islands(found: DataFrame, ref_seq: DataFrame, seqs: DataFrame) -> DataFrame:
    """Share of sequences that truly contain each island's reference text."""
    from strandframe.operators.joins import pair_all
    text = found.join(ref_seq.select("ref_id", F.col("seq").alias("_ref")), "ref_id").withColumn(
        "island", F.expr("substring(_ref, start + 1, `end` - start)")).drop("_ref")
    probes = text.select("island").distinct()
    share = pair_all(probes, seqs.select("seq")).groupBy("island").agg(F.avg(F.contains("seq", "island").cast("double")).alias("containment"))
    return text.join(share, "island")


def coverage(bounds: DataFrame, keys: list[str] = [], span: int = SPAN) -> DataFrame:
    """Depth from each change point on: fragments start (+1) and end (-1), then a running sum."""
    events = bounds.select(*keys, F.inline(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("_d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("_d")))))
    change = events.groupBy(*keys, "pos").agg(F.sum("_d").alias("_d"))
    return ordered_scan(change, keys, "pos", [("depth", "sum", F.col("_d"))], span).drop("_d")


def site_stats(pileup: DataFrame) -> DataFrame:
    """Share of each base per column."""
    counts = pileup.groupBy("ref_pos", "base").agg(F.count("*").alias("n"))
    total = counts.groupBy("ref_pos").agg(F.sum("n").alias("_t"))
    return counts.join(total, "ref_pos").select("ref_pos", "base", "n", (F.col("n") / F.col("_t")).alias("share"))


def snps_per_sequence(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    hit = pileup.filter(~F.col("is_match")).join(sites.select("ref_pos"), "ref_pos", "left_semi")
    return hit.groupBy("seq_id").agg(F.count("*").alias("n_snps"))


def sequences_per_snp(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    hit = pileup.filter(~F.col("is_match")).join(sites.select("ref_pos"), "ref_pos", "left_semi")
    return hit.groupBy("ref_pos").agg(F.count("*").alias("n_seqs"))


def log_mean_island(runs: DataFrame) -> DataFrame:
    """log2 of the mean forward run per column."""
    return runs.groupBy("ref_pos").agg(F.log2(F.avg("forward")).alias("log_run"))


def coord_map(aligned: DataFrame, keys: list[str] = ["seq_id"], span: int = SPAN) -> DataFrame:
    """Alignment column → letter index in test and reference by cumulative letters.

    ``aligned(…keys, col, base, ref_base)`` with '-' for gaps.
    """
    def letter(c):
        return F.when(F.col(c) != "-", 1).otherwise(0)
    out = ordered_scan(aligned, keys, "col", [("_t", "sum", letter("base")), ("_r", "sum", letter("ref_base"))], span)
    return out.select(*keys, "col", (F.col("_t") - 1).alias("test_pos"), (F.col("_r") - 1).alias("ref_pos"),
                      (letter("base") == 1).alias("has_base"))


def _texts(seqs: DataFrame) -> DataFrame:
    return seqs.filter("seq_id IS NOT NULL AND seq IS NOT NULL")


def _letter_columns(ref: DataFrame, gaps: list[str]) -> DataFrame:
    """Columns of one reference: ``col`` and ``is_letter`` (1 or 0)."""
    return _letters(ref.select("seq"), "seq").select(F.col("ref_pos").cast("long").alias("col"), F.when(F.col("base").isin(*gaps), 0).otherwise(1).alias("is_letter"))


def coord_sums(seqs: DataFrame, ref: DataFrame, gaps: list[str] = ["-"], span: int = SPAN) -> DataFrame:
    """Sums of ``coord_map``'s indices over the columns of each sequence laid on ``ref(seq)``: seq_id, sum_test, sum_ref.

    A letter at column i is in the index of every column from i on, so the number and the places of the letters
    say the sums and no column becomes a row. Equal rows lie on the same columns, one after the other, as they
    do in ``coord_map``; different texts of one id are summed each by itself.
    """
    pieces = _texts(seqs).select("seq_id", F.xxhash64("seq").alias("_text"), F.greatest(F.length("seq"), F.lit(1)).cast("long").alias("size"),
                                 F.posexplode(chunks("seq", span, 0)).alias("_part", "_piece"))
    places = F.filter(F.transform(F.split("_piece", ""), lambda x, i: F.when(~x.isin(*gaps), i.cast("long"))), lambda i: i.isNotNull())
    here = pieces.select("seq_id", "_text", "size", "_part", places.alias("_at"))
    of_piece = F.aggregate("_at", F.lit(0).cast("long"), lambda a, x: a + x) + F.col("_part") * span * F.size("_at")
    m, size = F.col("_times"), F.col("size")
    texts = here.groupBy("seq_id", "_text", "size").agg(
        F.sum((F.col("_part") == 0).cast("long")).alias("_times"), F.sum(F.size("_at")).alias("_k"), F.sum(of_piece).alias("_s")).withColumns({
            "_k": (F.col("_k") / m).cast("long"), "_s": (F.col("_s") / m).cast("long")})
    cells = _letter_columns(ref, gaps).withColumn("_one", F.lit(0))
    sums = ordered_scan(cells, ["_one"], "col", [("_rk", "sum", F.col("is_letter")), ("_rs", "sum", F.col("is_letter") * F.col("col"))], span)
    up_to = sums.select((F.col("col") + 1).alias("_end"), "_rk", "_rs")
    last = ref.select(F.greatest(F.length("seq"), F.lit(1)).cast("long").alias("_last"))
    met = texts.crossJoin(F.broadcast(last)).withColumn("_end", F.least("size", "_last")).join(maybe_broadcast(up_to), "_end")

    def total(k: str, s: str):
        before = (size - 1) * F.col(k) - F.col(s)  # pairs of a letter and a later column
        return m * m * before + (F.col(k) * m * (m + 1) / 2).cast("long") - m * size

    return met.select("seq_id", total("_k", "_s").alias("sum_test"), total("_rk", "_rs").alias("sum_ref")).groupBy("seq_id").agg(
        F.sum("sum_test").alias("sum_test"), F.sum("sum_ref").alias("sum_ref"))


def lift_on_reference(seqs: DataFrame, ref: DataFrame, start: int, end: int, gaps: list[str] = ["-"], span: int = SPAN) -> DataFrame:
    """``lift_range`` of one range to every sequence laid on ``ref(seq)``.

    The column at which an end is reached is the same for all sequences, so only their letters up to
    it matter. Rows of one id that are equal so far lie on the same columns, one after the other, as they do in
    ``coord_map``; of those that differ the least result counts.
    """
    cells = _letter_columns(ref, gaps).withColumn("_one", F.lit(0))
    ranked = ordered_scan(cells, ["_one"], "col", [("_r", "sum", F.col("is_letter"))], span).filter("is_letter = 1").select("_r", "col")
    ranked = cut_lineage(ranked.filter(F.col("_r") <= max(start, end, 0) + 1))
    wide = ranked.groupBy().agg(F.coalesce(F.max("col") + 2, F.lit(1)).cast("int").alias("_wide"))
    heads = _texts(seqs).crossJoin(F.broadcast(wide)).select("seq_id", F.substring("seq", F.lit(1), F.col("_wide")).alias("seq"))
    out = heads.groupBy("seq_id", "seq").agg(F.count("*").alias("_m"))
    m = F.col("_m")
    for name, value in (("lifted_start", start), ("lifted_end", end)):
        # of m equal rows the letter that makes the index reach ``value`` is the k-th, in its j-th row
        k = F.greatest(F.ceil(F.lit(value + 1) / m), F.lit(1)).cast("long")
        out = out.withColumn("_r", k).join(maybe_broadcast(ranked), "_r", "left")
        letters = F.transform(F.split(F.substring("seq", F.lit(1), (F.col("col") + 1).cast("int")), ""), lambda x: F.when(x.isin(*gaps), 0).otherwise(1))
        cum = F.aggregate(F.slice(letters, 1, F.col("col").cast("int")), F.lit(0), lambda a, x: a + x)
        own = F.element_at(letters, (F.col("col") + 1).cast("int"))
        j = F.greatest(F.lit(value + 1) - m * (F.col("_r") - 1), F.lit(1))
        reached = F.col("col") < F.greatest(F.length("seq"), F.lit(1))
        out = out.withColumn(name, F.when(reached, m * cum + j * own - 1)).drop("_r", "col")
    return out.groupBy("seq_id").agg(F.min("lifted_start").alias("lifted_start"), F.min("lifted_end").alias("lifted_end")).select(
        "seq_id", F.lit(start).alias("start"), F.lit(end).alias("end"), "lifted_start", "lifted_end")


def monotone(mapping: DataFrame, keys: list[str], pos: str, value: str, span: int = SPAN) -> DataFrame:
    """Mapping rows that do not fall back behind an earlier one."""
    out = ordered_scan(mapping, keys, pos, [("_m", "max_before", F.col(value))], span)
    return out.filter(F.col("_m").isNull() | (F.col(value) > F.col("_m"))).drop("_m")


def lift_range(mapping: DataFrame, ranges: DataFrame, keys: list[str] = ["seq_id"]) -> DataFrame:
    """Ranges lifted through a map: first position whose mapped value reaches each end."""
    m = mapping.select(*keys, F.col("ref_pos").alias("_v"), "test_pos")
    j = ranges.join(m, keys)
    return j.groupBy(*ranges.columns).agg(
        F.min(F.when(F.col("_v") >= F.col("start"), F.col("test_pos"))).alias("lifted_start"),
        F.min(F.when(F.col("_v") >= F.col("end"), F.col("test_pos"))).alias("lifted_end"))


def intervals_with_sites(intervals: DataFrame, sites: DataFrame) -> DataFrame:
    """Intervals that contain at least one site."""
    one = F.lit(0).alias("_one")
    hit = range_join(sites.select("ref_pos", one), intervals.select("start", "end", one), ["_one"], "ref_pos", "start", "end")
    return intervals.join(hit.select("start", "end").distinct(), ["start", "end"], "left_semi")


def interval_mean(intervals: DataFrame, profile: DataFrame, value: str) -> DataFrame:
    """Mean profile within each interval."""
    one = F.lit(0).alias("_one")
    j = range_join(profile.select("ref_pos", value, one), intervals.select("start", "end", one), ["_one"], "ref_pos", "start", "end")
    return j.groupBy("start", "end").agg(F.avg(value).alias("mean_value"))
