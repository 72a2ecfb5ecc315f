"""Grouped summaries over annotation, regimen and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.operators.ordered import best_row, union_all
from strandframe.session import maybe_broadcast


def score_list(ids: DataFrame, annots: DataFrame, motifs: DataFrame) -> DataFrame:
    """Instances of each motif over the listed proteins, zeros included."""
    counted = annots.join(ids.select("gene").distinct(), "gene", "left_semi").groupBy("motif").agg(F.count("*").alias("n"))
    return motifs.select("motif").distinct().join(counted, "motif", "left").select("motif", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def by_category(df: DataFrame) -> DataFrame:
    """Distinct gene count and gene set of each category and term."""
    pairs = df.select("category", "term", "gene").distinct()
    return pairs.groupBy("category", "term").agg(
        F.count("*").alias("count"), F.sort_array(F.collect_list("gene")).alias("genes"))


def index_by(annots: DataFrame, key: str, other: str, only: dict[str, list] | None = None, piece: int = 65536) -> DataFrame:
    """Inverted index: spans of ``other`` under each ``key``, optionally restricted to given values.

    The spans of one pair come in pieces of the position axis, so that no list grows with
    the data: (key, other, part, spans).
    """
    for col, values in (only or {}).items():
        annots = annots.filter(F.col(col).isin(*values))
    return annots.groupBy(key, other, F.floor(F.col("start") / piece).alias("part")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def dedupe_spans(annots: DataFrame, key: list[str]) -> DataFrame:
    """One row per (key, start, end): the first in column order."""
    rest = [c for c in annots.columns if c not in (*key, "start", "end")]
    return annots.groupBy(*key, "start", "end").agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "start", "end", "_r.*")


def avg_duplicates(timeline: DataFrame, keys: list[str], week: str = "week", val: str = "val") -> DataFrame:
    """One averaged value per (key, week)."""
    return timeline.groupBy(*keys, week).agg(F.avg(val).alias(val))


def collapse(expr: DataFrame, probe_map: DataFrame) -> DataFrame:
    """Gene values as the median over the gene's probes."""
    return expr.join(maybe_broadcast(probe_map), "probe").groupBy("gene", "sample").agg(F.median("value").alias("value"))


def aggregate_rows(df: DataFrame, predictors: list[str], response: str) -> DataFrame:
    """Unique predictor rows with counts of each response (missing equals missing)."""
    return df.groupBy(*predictors).agg(
        F.sum(F.when(~F.col(response), 1).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col(response), 1).otherwise(0)).alias("n1"))


def cohort_stats(patients: DataFrame) -> DataFrame:
    """Patients, responders and sequenced patients per study, per therapy and overall.

    ``patients(pat, study, therapy, responder, has_seq)``.
    """
    grouped = patients.groupingSets([["study"], ["therapy"], []], "study", "therapy").agg(
        F.count("*").alias("n_patients"),
        F.sum(F.col("responder").cast("long")).alias("n_responders"),
        F.sum(F.col("has_seq").cast("long")).alias("n_sequences"),
        F.grouping_id().alias("grain"))
    return grouped


def initial_therapy(regimen: DataFrame, patients: DataFrame) -> DataFrame:
    """Drugs of the first regimen at or after time 0, 'Discarded' when there is none.

    ``regimen(pat, start, drug)``.
    """
    study = regimen.filter(F.col("start") >= 0)
    first = study.groupBy("pat").agg(F.min("start").alias("start"))
    drugs = study.join(first, ["pat", "start"], "left_semi").groupBy("pat").agg(
        F.concat_ws(", ", F.sort_array(F.collect_set("drug"))).alias("therapy"))
    return patients.select("pat").distinct().join(drugs, "pat", "left").select(
        "pat", F.coalesce("therapy", F.lit("Discarded")).alias("therapy"))


def therapy_hist(regimen: DataFrame, until: float = 24, min_count: int = 1) -> DataFrame:
    """How often each drug set starts before and during the study window."""
    before = F.sum(F.when(F.col("start") < 0, 1).otherwise(0)).alias("n_before")
    during = F.sum(F.when(F.col("start").between(0, until), 1).otherwise(0)).alias("n_during")
    out = regimen.groupBy("drugs").agg(before, during)
    return out.filter(F.col("n_before") + F.col("n_during") >= min_count)


def regimen_cohorts(regimen: DataFrame, n: int, max_size: int = 3) -> DataFrame:
    """Combinations of 1 to 3 drugs taken together by at least ``n`` patients.

    ``regimen(pat, drug)``. A drug below ``n`` cannot be part of a larger cohort, so it
    is dropped first. A patient's drug list is as long as the drug vocabulary at most;
    its combinations are built inside the row, without a self-join.
    """
    pairs = regimen.select("pat", "drug").distinct()
    common = pairs.groupBy("drug").agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select("drug")
    lists = pairs.join(common, "drug", "left_semi").groupBy("pat").agg(F.sort_array(F.collect_set("drug")).alias("d"))
    combos = F.expr("transform(d, x -> array(x))")
    parts = [combos]
    if max_size >= 2:
        parts.append(F.expr(
            "flatten(transform(d, (x, i) -> transform(slice(d, i + 2, size(d)), y -> array(x, y))))"))
    if max_size >= 3:
        parts.append(F.expr(
            "flatten(transform(d, (x, i) -> flatten(transform(slice(d, i + 2, size(d)), (y, j) -> "
            "transform(slice(d, i + j + 3, size(d)), z -> array(x, y, z))))))"))
    return (
        lists.select("pat", F.explode(F.concat(*parts)).alias("drugs"))
        .groupBy("drugs").agg(F.count("*").alias("n_patients")).filter(F.col("n_patients") >= n)
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cell counts with row and column totals (long form)."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("row_total"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("col_total"))
    return cells.join(rows, a).join(cols, b)


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Wide contingency table for known column values."""
    return df.groupBy(a).pivot(b, values).count().na.fill(0)


def membership_matrix(df: DataFrame, terms: list[str], probe: str = "probe", term: str = "term") -> DataFrame:
    """Probe rows with one boolean column per term."""
    return df.groupBy(probe).agg(*[
        F.coalesce(F.max(F.when(F.col(term) == t, F.lit(True))), F.lit(False)).alias(t) for t in terms
    ])


def common_times(timeline: DataFrame, n: int, week: str = "week") -> DataFrame:
    """The n-1 most common observation times after time 0, and time 0."""
    top = timeline.filter(F.col(week) > 0).groupBy(week).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), week).limit(n - 1)
    zero = timeline.sparkSession.range(1).select(F.lit(0).cast(timeline.schema[week].dataType).alias(week))
    return top.select(week).union(zero)


def term_lists(chart: DataFrame, categories: list[str]) -> DataFrame:
    """Terms of each gene, one list column per category."""
    long = chart.select("category", "term", F.explode("genes").alias("gene"))
    return long.groupBy("gene").agg(*[
        F.sort_array(F.collect_set(F.when(F.col("category") == c, F.col("term")))).alias(c) for c in categories
    ])


def patient_field(table: DataFrame, field: str, mode: str = "leave", key: str = "pat") -> DataFrame:
    """One field of the patient tables: ``explode`` gives a row per value (NULL for none), ``leave`` the stored array."""
    kept = table.select(key, field)
    return kept.select(key, F.explode_outer(field).alias(field)) if mode == "explode" else kept


def significant(chart: DataFrame, cut: float) -> DataFrame:
    """Genes of the terms with p below the cut."""
    return chart.filter(F.col("pvalue") < cut).select(F.explode("genes").alias("gene")).distinct()


def prediction_sets(predictions: DataFrame) -> DataFrame:
    """Distinct h1, h2, union and edge counts per (virus, motif), per virus and overall.

    Ends are few and condensed first; only edges meet the three grains as they come.
    """
    ends = predictions.select("virus", "motif", F.inline(F.array(
        F.struct(F.lit("H1").alias("role"), F.col("h1").alias("member")),
        F.struct(F.lit("H2").alias("role"), F.col("h2").alias("member"))))).distinct()
    ends = ends.select("virus", "motif", F.explode(F.array("role", F.lit("H12"))).alias("role"), "member")
    links = predictions.select("virus", "motif", F.lit("H1toH2").alias("role"), F.concat_ws(">", "h1", "h2").alias("member"))
    every = F.lit("all")
    grains = F.array(*[F.struct(v.alias("virus"), m.alias("motif")) for v, m in ((F.col("virus"), F.col("motif")), (F.col("virus"), every), (every, every))])
    members = ends.unionByName(links).select("role", "member", F.inline(grains)).distinct()
    return members.groupBy("virus", "motif", "role").agg(F.count("*").alias("n"))


def summarise_runs(runs: DataFrame) -> DataFrame:
    """Mean sign, mean size, deviation and count of a feature's weight over repeated runs."""
    w = F.col("weight")
    return runs.filter(w.isNotNull() & ~F.isnan(w)).groupBy("feature").agg(
        F.avg(F.signum(w)).alias("mean_sign"), F.avg(F.abs(w)).alias("mean_abs"),
        F.stddev_samp(w).alias("sd"), F.count("*").alias("n_runs"))


def partition_modes(parts: DataFrame, n: int) -> DataFrame:
    """Most frequent partitions and their share: ``parts(iter, sample, cluster)``.

    Clusters are renamed by their first sample, so equal groupings compare equal. A cluster is
    condensed to order-free sums of its hashed samples where its rows are made, an iteration to sums
    over its clusters; rows are read once and only a row per cluster and task moves.
    """
    first, second = F.xxhash64("sample"), F.xxhash64(F.lit("#"), "sample")
    sums = [F.sum(half).alias(f"s{k}") for k, half in enumerate(
        half for h in (first, second) for half in (F.shiftright(h, 32), h.bitwiseAND(F.lit(2**32 - 1))))]  # halves, as whole hashes would overflow
    clusters = parts.filter("iter IS NOT NULL AND cluster IS NOT NULL").groupBy("iter", "cluster").agg(F.min("sample").alias("name"), *sums)
    names = clusters.groupBy("iter", "name").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
    prints = names.groupBy("iter").agg(
        F.sum(F.xxhash64("name", "s0", "s1", "s2", "s3").cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64("s3", "s2", "s1", "s0", F.lit("#"), "name").cast("decimal(38,0)")).alias("h2"),
        F.count("name").alias("n_clusters"))
    modes = prints.groupBy("h1", "h2", "n_clusters").agg(F.count("*").alias("n"), F.min("iter").alias("first_iter"))
    total = prints.agg(F.count("*").alias("_total"), F.first(F.lit(0)).alias("_k"))
    top = modes.orderBy(F.desc("n"), "first_iter").limit(n).withColumn("_k", F.lit(0))
    return top.join(F.broadcast(total), "_k").select(
        "first_iter", "n_clusters", "n", (F.col("n") / F.col("_total")).alias("share"))
