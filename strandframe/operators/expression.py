"""Differential expression over long tables ``(gene, sample, value, cls)``.

``keys`` carry several datasets through one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.functions.special import binom_sf, t_two_sided
from strandframe.operators.joins import pair_all
from strandframe.operators.ordered import exact_ranks
from strandframe.operators.sampling import hash_draw
from strandframe.session import cut_lineage, maybe_broadcast


def fold_change(expr: DataFrame, control=0, up: float = 1.5, down: float = 0.7, keys: list[str] = []) -> DataFrame:
    """Mean of each class over the control class mean, flagged beyond the limits."""
    means = expr.groupBy(*keys, "gene", "cls").agg(F.avg("value").alias("_m"))
    base = means.filter(F.col("cls") == control).select(*keys, "gene", F.col("_m").alias("_base"))
    out = means.filter(F.col("cls") != control).join(base, [*keys, "gene"])
    out = out.withColumn("fold", F.col("_m") / F.col("_base"))
    return out.select(*keys, "gene", "cls", "fold", ((F.col("fold") > up) | (F.col("fold") < down)).alias("changed"))


def _moments(expr: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """Counts, sums and square sums of the two groups per gene, in one pass."""
    v = F.col("value")

    def part(cond, tag):
        return [F.sum(cond.cast("long")).alias(f"n{tag}"), F.sum(F.when(cond, v)).alias(f"s{tag}"), F.sum(F.when(cond, v * v)).alias(f"q{tag}")]

    return expr.groupBy(*keys, "gene").agg(*part(first, 1), *part(~first, 0))


def _mean(tag):
    return F.col(f"s{tag}") / F.col(f"n{tag}")


def _ss(tag):
    return F.greatest(F.col(f"q{tag}") - F.col(f"s{tag}") * F.col(f"s{tag}") / F.col(f"n{tag}"), F.lit(0.0))


def _pooled_error() -> Column:
    n1, n0 = F.col("n1"), F.col("n0")
    return F.sqrt((1 / n1 + 1 / n0) / (n1 + n0 - 2) * (_ss(1) + _ss(0)))


def ttest(expr: DataFrame, cls=1, alpha: float = 0.001, keys: list[str] = []) -> DataFrame:
    """Two-sample t-test of class ``cls`` against the rest, Bonferroni over genes."""
    m = _moments(expr, keys, F.col("cls") == cls)
    out = m.select(*keys, "gene", ((_mean(1) - _mean(0)) / _pooled_error()).alias("t"), (F.col("n1") + F.col("n0") - 2).alias("df"))
    out = out.withColumn("p", t_two_sided("t", "df"))
    genes = out.groupBy(*keys).agg(F.count("*").alias("_g")) if keys else out.agg(F.count("*").alias("_g"))
    joined = pair_all(genes, out) if not keys else out.join(genes, keys)
    return joined.withColumn("is_significant", F.col("p") <= alpha / F.col("_g")).drop("_g")


def snr(expr: DataFrame, cls=1, keys: list[str] = []) -> DataFrame:
    """Signal to noise: mean difference over the summed deviations."""
    m = _moments(expr, keys, F.col("cls") == cls)
    return m.select(*keys, "gene", _snr().alias("snr"))


def _snr() -> Column:
    sd1, sd0 = F.sqrt(_ss(1) / (F.col("n1") - 1)), F.sqrt(_ss(0) / (F.col("n0") - 1))
    return (_mean(1) - _mean(0)) / (sd1 + sd0)


def permuted_moments(expr: DataFrame, cls, reps: int, seed: int = 0, keys: list[str] = []) -> DataFrame:
    """Two-group moments of every gene for the true labels (rep -1) and ``reps`` permutations.

    A sample carries the list of repetitions that put it into the first group, so the
    values are shuffled once; the second group is total minus first. Data sets (``keys``) are permuted each by itself.
    """
    samples = expr.select(*keys, "sample", "cls").distinct()
    real = samples.filter(F.col("cls") == cls)
    if keys:
        sizes = real.groupBy(*keys).agg(F.count("*").alias("_size"))
        drawn = hash_draw(samples.join(sizes, keys), "sample", reps, "_size", keys, seed)
    else:
        drawn = hash_draw(samples, "sample", reps, real.count(), seed=seed)
    drawn = drawn.unionByName(real.select(*keys, F.lit(-1).alias("rep"), "sample"))
    packed = drawn.groupBy(*keys, "sample").agg(F.collect_list("rep").alias("_reps"))
    rows = expr.join(packed, [*keys, "sample"]).select(*keys, "gene", "value", F.explode("_reps").alias("rep"))
    v = F.col("value")
    first = rows.groupBy(*keys, "rep", "gene").agg(F.count("*").alias("n1"), F.sum(v).alias("s1"), F.sum(v * v).alias("q1"))
    total = expr.groupBy(*keys, "gene").agg(F.count("*").alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    return first.join(total, [*keys, "gene"]).select(
        *keys, "rep", "gene", "n1", "s1", "q1", (F.col("_n") - F.col("n1")).alias("n0"),
        (F.col("_s") - F.col("s1")).alias("s0"), (F.col("_q") - F.col("q1")).alias("q0"))


def sam_fudge(stats: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Constant added to the standard error: the quantile of s for which the spread of d depends least on s: (keys, s0).

    0 where no quantile has a spread.
    """
    alphas = F.array(*[F.lit(i / 20) for i in range(21)])
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    marks = stats.groupBy(*keys).agg(F.percentile("s", alphas).alias("_q"), F.percentile("s", cuts).alias("_cuts"))
    marks = cut_lineage(marks)
    tried = stats.join(maybe_broadcast(marks), keys).select(
        *keys, "diff", "s", F.size(F.filter("_cuts", lambda c: F.col("s") >= c)).alias("_b"), F.explode(F.array_distinct("_q")).alias("_s0"))
    d = tried.withColumn("_d", F.try_divide(F.col("diff"), F.col("s") + F.col("_s0")))
    group = [*keys, "_s0", "_b"]
    centre = d.groupBy(*group).agg(F.median("_d").alias("_mid"))
    mad = d.join(centre, group).groupBy(*group).agg(F.median(F.abs(F.col("_d") - F.col("_mid"))).alias("_v"))
    cv = mad.groupBy(*keys, "_s0").agg(F.try_divide(F.stddev_samp("_v"), F.avg("_v")).alias("_cv")).filter("_cv IS NOT NULL")
    best = cv.groupBy(*keys).agg(F.min(F.struct("_cv", "_s0")).alias("_best"))
    return marks.select(*keys).join(best, keys, "left").select(*keys, F.coalesce("_best._s0", F.lit(0.0)).alias("s0"))


def sam_statistics(expr: DataFrame, cls=1, reps: int = 100, seed: int = 0, s0: float | None = None,
                   keys: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(observed, permuted) regularised differences with their order statistics, all data sets in the same jobs.

    Observed rows: keys, gene, d, expected (mean of the permuted values of the same rank). A data set
    without samples on both sides, or with two samples in all, has no rows. Keys must not be null.
    """
    group = keys or ["_all"]
    m = permuted_moments(expr, cls, reps, seed, keys).filter("n1 > 0 AND n0 > 0 AND n1 + n0 > 2")
    m = cut_lineage(m.select(*(keys or [F.lit(0).alias("_all")]), "rep", "gene", (_mean(1) - _mean(0)).alias("diff"), _pooled_error().alias("s")))
    if s0 is None:
        m = m.join(maybe_broadcast(cut_lineage(sam_fudge(m.filter("rep = -1"), group))), group)
    else:
        m = m.withColumn("s0", F.lit(s0))
    scored = m.select(*group, "rep", "gene", F.try_divide(F.col("diff"), F.col("s") + F.col("s0")).alias("d"))
    ranked = cut_lineage(exact_ranks(scored, [*group, "rep"], [F.col("d"), F.col("gene")]))
    permuted = ranked.filter("rep >= 0")
    expected = permuted.groupBy(*group, "rank").agg(F.avg("d").alias("expected"))
    observed = ranked.filter("rep = -1").join(expected, [*group, "rank"]).select(*keys, "gene", "d", "expected")
    return observed, permuted.select(*keys, "rep", "gene", "d")


def sam(expr: DataFrame, cls=1, reps: int = 100, target: float = 1.0, seed: int = 0, steps: int = 20, keys: list[str] = []) -> DataFrame:
    """Genes called at the smallest delta whose expected number of false calls is at most ``target``.

    A table of deltas replaces a search: each gets its cut-offs and false count in one pass. Each
    data set (``keys``) has its own permutations, constant and delta; all are keys of the same jobs.
    """
    observed, permuted = sam_statistics(expr, cls, reps, seed, keys=keys)
    group = keys or ["_all"]
    if not keys:
        observed, permuted = (df.withColumn("_all", F.lit(0)) for df in (observed, permuted))
    observed = cut_lineage(observed)
    gap = F.col("d") - F.col("expected")
    deltas = cut_lineage(observed.groupBy(*group).agg(F.percentile(F.abs(gap), F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("q")).select(
        *group, F.explode(F.array_distinct("q")).alias("delta")))
    cuts = cut_lineage(observed.join(maybe_broadcast(deltas), group).groupBy(*group, "delta").agg(
        F.max(F.when(gap < -F.col("delta"), F.col("d"))).alias("lower"),
        F.min(F.when(gap > F.col("delta"), F.col("d"))).alias("upper")))
    outside = F.coalesce(F.col("d") <= F.col("lower"), F.lit(False)) | F.coalesce(F.col("d") >= F.col("upper"), F.lit(False))
    falses = permuted.join(maybe_broadcast(cuts), group).groupBy(*group, "delta").agg((F.sum(outside.cast("long")) / reps).alias("n_false"))
    chosen = cut_lineage(falses.filter(F.col("n_false") <= target).groupBy(*group).agg(F.min("delta").alias("delta")))
    out = observed.join(maybe_broadcast(chosen), group, "left")
    return out.select(*keys, "gene", "d", "expected", F.coalesce(F.abs(gap) > F.col("delta"), F.lit(False)).alias("called"))


def analyse_all(expr: DataFrame, method: str = "fold", keys: list[str] = ["dataset"], cls=1) -> DataFrame:
    """One method over every dataset at once: genes with a ``changed`` flag."""
    if method == "fold":
        return fold_change(expr, keys=keys)
    if method == "ttest":
        return ttest(expr, cls, keys=keys).withColumnRenamed("is_significant", "changed")
    if method == "sam":  # a struct of the keys is never null itself
        packed = expr.select(F.struct(*keys).alias("_set"), "gene", "sample", "value", "cls")
        return sam(packed, cls, keys=["_set"]).select("_set.*", "gene", "d", F.col("called").alias("changed"))
    raise ValueError(f"unknown method {method}")


def sized_sets(gene_sets: DataFrame, genes: DataFrame, low: int = 5, high: int = 500) -> DataFrame:
    """Gene sets restricted to measured genes, with more than 5 and fewer than 500 of them left."""
    known = gene_sets.select("set_name", "gene").distinct().join(genes.select("gene").distinct(), "gene", "left_semi")
    sizes = known.groupBy("set_name").agg(F.count("*").alias("size")).filter((F.col("size") > low) & (F.col("size") < high))
    return known.join(sizes, "set_name")


def enrichment_scores(ranked: DataFrame, sets: DataFrame, weight: float = 5.0) -> DataFrame:
    """Running-sum score per (rep, set) from ``ranked(rep, gene, snr, rank, n_genes)``.

    The walk only turns at members, so only member rows are kept: the sum after the j-th
    member at rank r is its weight share minus (r - j) steps down.
    """
    hits = ranked.join(sets, "gene").withColumn("_w", F.pow(F.abs("snr"), F.lit(weight)))
    w = Window.partitionBy("rep", "set_name").orderBy("rank")
    whole = Window.partitionBy("rep", "set_name")
    walked = hits.withColumns({
        "_j": F.row_number().over(w), "_cum": F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(whole)})
    down = (F.col("rank") - F.col("_j")) / (F.col("n_genes") - F.col("size"))
    after = F.col("_cum") / F.col("_all") - down
    before = (F.col("_cum") - F.col("_w")) / F.col("_all") - down
    top = walked.groupBy("rep", "set_name", "size").agg(F.max(after).alias("_hi"), F.min(before).alias("_lo"))
    return top.select("rep", "set_name", "size", F.when(F.col("_hi") >= -F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("es"))


def gsea(expr: DataFrame, gene_sets: DataFrame, cls=1, reps: int = 100, weight: float = 5.0, seed: int = 0,
         low: int = 5, high: int = 500) -> DataFrame:
    """Gene-set enrichment with permuted labels: es, nes, p and fdr per set."""
    sets = sized_sets(gene_sets, expr, low, high)
    scores = permuted_moments(expr, cls, reps, seed).select("rep", "gene", _snr().alias("snr"))
    ranked = exact_ranks(scores, ["rep"], [F.desc("snr"), F.col("gene")], total="n_genes")
    es = cut_lineage(enrichment_scores(ranked, sets, weight))
    null, observed = es.filter("rep >= 0"), es.filter("rep = -1").drop("rep")
    scale = null.groupBy("set_name").agg(
        F.avg(F.when(F.col("es") > 0, F.col("es"))).alias("_pos"), F.avg(F.when(F.col("es") <= 0, F.abs("es"))).alias("_neg"))

    def nes(df):
        return df.join(scale, "set_name").withColumn(
            "nes", F.col("es") / F.nullif(F.when(F.col("es") > 0, F.col("_pos")).otherwise(F.col("_neg")), F.lit(0.0)))

    real = nes(observed).select("set_name", "size", "es", "nes")
    compared = nes(null).select("set_name", F.col("es").alias("_es"), F.col("nes").alias("_nes")).join(real, "set_name")
    beyond = F.when(F.col("es") > 0, F.col("_es") >= F.col("es")).otherwise(F.col("_es") <= F.col("es"))
    beyond_n = F.when(F.col("es") > 0, F.col("_nes") >= F.col("nes")).otherwise(F.col("_nes") <= F.col("nes"))
    side = F.when(F.col("es") > 0, F.col("_nes") >= 0).otherwise(F.col("_nes") <= 0)
    counted = compared.groupBy("set_name").agg(
        (F.sum(beyond.cast("long")) / F.lit(reps)).alias("p"),
        (F.sum(beyond_n.cast("long")) / F.nullif(F.sum(side.cast("long")), F.lit(0))).alias("fdr"))
    return real.join(counted, "set_name")


def bss_wss(df: DataFrame, feature: str = "gene", keys: list[str] = []) -> DataFrame:
    """Between- over within-class sum of squares of each feature."""
    v = F.col("value")
    per = df.filter(v.isNotNull()).groupBy(*keys, feature, "cls").agg(F.count("*").alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    between = F.sum(F.col("_s") * F.col("_s") / F.col("_n")) - F.pow(F.sum("_s"), F.lit(2)) / F.sum("_n")
    within = F.sum(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n"))
    return per.groupBy(*keys, feature).agg((between / F.nullif(within, F.lit(0.0))).alias("ratio"))


def on_in_class(expr: DataFrame, thresholds: DataFrame, cls=1, alpha: float = 0.05) -> DataFrame:
    """Genes above their threshold in most samples of a class (strict binomial tail)."""
    rows = expr.filter(F.col("cls") == cls).join(thresholds, "gene").filter("threshold IS NOT NULL")
    out = rows.groupBy("gene").agg(F.sum((F.col("value") > F.col("threshold")).cast("long")).alias("n_on"), F.count("*").alias("n"))
    out = out.withColumn("p", binom_sf("n_on", "n", 0.5))
    return out.withColumn("is_on", F.col("p") <= alpha)


def filter_effects(effects: DataFrame, p_cut: float = 0.05, min_runs: int = 2, min_size: float = 0.0) -> DataFrame:
    """Features with enough significant observations and one large enough: (feature, n_seen, max_abs)."""
    kept = effects.filter(F.col("p") <= p_cut)
    out = kept.groupBy("feature").agg(F.count("*").alias("n_seen"), F.max(F.abs("weight")).alias("max_abs"))
    return out.filter((F.col("n_seen") >= min_runs) & (F.col("max_abs") >= min_size))


def roc(df: DataFrame, grid: list[float], keys: list[str] = []) -> DataFrame:
    """True and false positive rate at each threshold (score >= threshold)."""
    bucket = sum(((F.col("score") >= t).cast("int") for t in grid), F.lit(0))
    pos, neg = F.col("cls") == 1, F.col("cls") != 1
    counts = df.groupBy(*keys, bucket.alias("_b")).agg(F.sum(pos.cast("long")).alias("_p"), F.sum(neg.cast("long")).alias("_n"))
    # each bucket passes the first _b thresholds of the ascending grid
    levels = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(sorted(grid))])
    rows = counts.select(*keys, "_b", "_p", "_n", F.inline(levels))
    passed = F.col("_b") >= F.col("_i")
    return rows.groupBy(*keys, "threshold").agg(
        (F.sum(F.when(passed, F.col("_p")).otherwise(0)) / F.sum("_p")).alias("tpr"),
        (F.sum(F.when(passed, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("fpr"))


def auc(df: DataFrame, keys: list[str] = [], span: float | None = None) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in right order, ties half.

    Scores are condensed to distinct values; negatives below each are a running sum.
    """
    from strandframe.operators.ordered import ordered_scan, value_span
    pos, neg = F.col("cls") == 1, F.col("cls") != 1
    base = df.withColumn("_one", F.lit(0)) if not keys else df
    group = keys or ["_one"]
    counts = base.groupBy(*group, "score").agg(F.sum(pos.cast("long")).alias("_p"), F.sum(neg.cast("long")).alias("_n"))
    running = ordered_scan(counts, group, "score", [("_upto", "sum", F.col("_n"))], span or value_span(df, "score"))
    area = F.sum(F.col("_p") * (F.col("_upto") - F.col("_n") / 2)) / (F.sum("_p") * F.sum("_n"))
    out = running.groupBy(*group).agg(area.alias("auc"))
    return out if keys else out.drop("_one")
