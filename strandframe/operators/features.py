"""Feature intervals: merging, fuzzy and nearest matching, anchoring, gene assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.operators.joins import band_join
from strandframe.operators.ordered import ordered_scan, union_all
from strandframe.session import cut_lineage, maybe_broadcast

SPAN = 65536


def near(kind: Column, wanted: str, pos: Column, at: float, tol: float) -> Column:
    """Feature of a type starting within ``tol`` of a position."""
    return (kind == wanted) & (F.abs(pos - at) < tol)


def aa_to_nt(sites: DataFrame, genes: DataFrame) -> DataFrame:
    """Amino-acid coordinates lifted to the genome: three letters each from the gene's start."""
    g = genes.select("gene", F.col("start").alias("_g"))
    return sites.join(g, "gene").withColumns(
        {"start": F.col("start") * 3 + F.col("_g"), "end": F.col("end") * 3 + F.col("_g")}).drop("_g")


def merge_intervals(df: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """Transitive merge of overlapping or touching half-open intervals."""
    starts = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    seen = ordered_scan(starts, keys, "start", [("_seen", "max_before", F.col("end"))], span)
    flagged = seen.withColumn("_new", F.when(F.coalesce(F.col("start") > F.col("_seen"), F.lit(True)), 1).otherwise(0))
    grouped = ordered_scan(flagged, keys, "start", [("_island", "sum", F.col("_new"))], span)
    return grouped.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


#: Features of one place that a row holds.
PLACE_ROWS = 65_536


def fuzzy_join(a: DataFrame, b: DataFrame, tol: float = 1000, aa_tol: float = 5) -> DataFrame:
    """Equal name and type at about the same place.

    Features with gene-relative starts on both sides are compared there (same gene,
    ``aa_tol``), the others by absolute start. Columns of ``b`` get the suffix ``_b``.

    Features of ``b`` at one place are one row with a bounded list of them, which is
    expanded behind the comparison, so pairs are neither compared one by one nor shuffled.
    """
    bb = b.select(*[F.col(c).alias(c if c in ("name", "type") else f"{c}_b") for c in b.columns])
    place = ["name", "type", "gene_b", "rel_start_b", "start_b"]
    rest = [c for c in bb.columns if c not in place]
    most = bb.groupBy(*place).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64(*rest), F.lit(-(-most // PLACE_ROWS) or 1)).alias("_part")
    at = cut_lineage(bb.groupBy(*place, part).agg(F.collect_list(F.struct(*rest)).alias("_rest")).drop("_part"))
    of_gene = F.col("rel_start_b").isNotNull() & F.col("gene_b").isNotNull()
    rel_a = a.filter(F.col("rel_start").isNotNull() & F.col("gene").isNotNull())
    by_gene = band_join(rel_a.withColumn("_g", F.col("gene")), maybe_broadcast(at.filter(of_gene).withColumn("_g", F.col("gene_b"))),
                        ["name", "type", "_g"], "rel_start", "rel_start_b", aa_tol).drop("_g")
    by_gene = by_gene.withColumn("distance", F.abs(F.col("rel_start") - F.col("rel_start_b")))
    both = F.col("rel_start").isNotNull() & F.col("gene").isNotNull() & of_gene
    by_start = band_join(a, maybe_broadcast(at), ["name", "type"], "start", "start_b", tol).filter(~both)
    by_start = by_start.withColumn("distance", F.abs(F.col("start") - F.col("start_b")))
    columns = [*a.columns, *[c for c in bb.columns if c not in ("name", "type")], "distance"]
    return by_gene.unionByName(by_start).select("*", F.inline("_rest")).select(*columns)


#: What a fuzzy join looks at; features equal in all of it are one class.
_PLACE = ["name", "type", "gene", "rel_start", "start"]


def _classed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (feat_id, other_id) with the least id of their class, and a row per class under that id."""
    classes = df.groupBy(*_PLACE).agg(F.min("feat_id").alias("other_id"))
    known = classes.select("other_id", *[F.col(c).alias(f"_{c}") for c in _PLACE])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _PLACE])
    return df.join(known, same).select("feat_id", "other_id"), classes.withColumnRenamed("other_id", "feat_id")


def fuzzy_join_classes(a: DataFrame, b: DataFrame, tol: float = 1000, aa_tol: float = 5) -> DataFrame:
    """``fuzzy_join`` without a row for every pair of equal features: (part, feat_id, other_id, distance).

    Parts ``a`` and ``b`` name the class of each feature by its least id, ``link`` the classes whose members are all joined.
    """
    (in_a, class_a), (in_b, class_b) = _classed(a), _classed(b)
    links = fuzzy_join(class_a, class_b, tol, aa_tol).select("feat_id", F.col("feat_id_b").alias("other_id"), "distance")
    members = [m.select("feat_id", "other_id", F.lit(None).cast(links.schema["distance"].dataType).alias("distance")) for m in (in_a, in_b)]
    return union_all([df.select(F.lit(part).alias("part"), "*") for part, df in zip(("a", "b", "link"), (*members, links))])


def greedy_match(candidates: DataFrame, scope: list[str], left: str, right: str, cost: str, max_rounds: int = 1000) -> DataFrame:
    """One-to-one matching, cheapest pair first.

    In each round every pair that is the cheapest for both of its ends is accepted and both
    ends retire. With a total order on pairs this gives the same matching as taking pairs
    one by one in order, but all scopes and far-apart pairs advance together.
    """
    ends = F.struct(cost, left, right)
    remaining = cut_lineage(candidates.select(*scope, left, right, cost))
    accepted = None
    for _ in range(max_rounds):
        best_left = remaining.groupBy(*scope, left).agg(F.min(ends).alias("_l"))
        best_right = remaining.groupBy(*scope, right).agg(F.min(ends).alias("_r"))
        mutual = cut_lineage(
            best_left.select(*scope, F.col("_l").alias("_p"))
            .join(best_right.select(*scope, F.col("_r").alias("_p")), [*scope, "_p"])
            .select(*scope, "_p.*"))
        accepted = mutual if accepted is None else accepted.unionByName(mutual)
        remaining = cut_lineage(
            remaining.join(mutual.select(*scope, left), [*scope, left], "left_anti")
            .join(mutual.select(*scope, right), [*scope, right], "left_anti"))
        if remaining.isEmpty():
            return accepted
    raise RuntimeError("matching did not finish")


def match_features(feats: DataFrame, wanted: DataFrame, tol: float = 50) -> DataFrame:
    """Which wanted features each sequence has; a feature can serve one wanted feature only.

    ``feats(seq_id, feat_id, type, name, start)``, ``wanted(want_id, type, name, start)``.
    """
    feats = feats.filter("seq_id IS NOT NULL")  # rows without a sequence would never find a partner, so rounds would not end
    # Wanted features of equal type, name and start differ in their number only, and of those the least free one is
    # taken. A sequence uses at most as many as it has features, so of each such class it needs no more than that.
    counted = feats.withColumn("_have", F.count("*").over(Window.partitionBy("seq_id")).cast("int"))
    most = feats.groupBy("seq_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranked = wanted.select("want_id", "type", "name", F.col("start").alias("_w")).distinct().withColumn(
        "_rank", F.row_number().over(Window.partitionBy("type", "name", "_w").orderBy(F.col("want_id").asc_nulls_last())))
    classes = ranked.filter(F.col("_rank") <= most).groupBy("type", "name", "_w").agg(F.array_sort(F.collect_set("want_id")).alias("_wants"))
    near = band_join(counted, maybe_broadcast(cut_lineage(classes)), ["type", "name"], "start", "_w", tol)
    pairs = near.select("seq_id", "feat_id", F.explode(F.slice("_wants", F.lit(1), F.col("_have"))).alias("want_id"), F.abs(F.col("start") - F.col("_w")).alias("distance"))
    return greedy_match(pairs, ["seq_id"], "want_id", "feat_id", "distance")


def nearest_feature(a: DataFrame, b: DataFrame, on: list[str], tol: float) -> DataFrame:
    """Nearest equivalent feature of ``b`` for each feature of ``a``."""
    from strandframe.operators.joins import nearest_join
    other = b.select(*on, F.col("start").alias("other_start"))
    return nearest_join(a, other, on, tol, "start", "other_start")


def anchor_costs(ref_feats: DataFrame, feats: DataFrame, n_seqs: int, tol: float = 1000, penalty: float = 10000) -> DataFrame:
    """Total displacement of each reference feature over all sequences; a missing one costs ``penalty``."""
    # Reference features of equal type, name and start cost the same and are looked for once.
    at = F.array_sort(F.collect_set(F.struct("type", "name", F.col("start").alias("_r"))))
    refs = cut_lineage(ref_feats.groupBy(F.col("feat_id").alias("ref_feat")).agg(at.alias("_at")))
    classes = cut_lineage(refs.groupBy("_at").agg(F.min("ref_feat").alias("_class")).filter("_class IS NOT NULL"))
    r = classes.select("_class", F.inline("_at"))
    # the features of a sequence meet once; joins and minima then stay where they are
    mine = feats.select("seq_id", "type", "name", "start").repartition("seq_id").distinct()
    near_pairs = band_join(mine, maybe_broadcast(cut_lineage(r)), ["type", "name"], "start", "_r", tol)
    per_seq = near_pairs.groupBy("_class", "seq_id").agg(F.min(F.abs(F.col("start") - F.col("_r"))).alias("_d"))
    found = per_seq.groupBy("_class").agg(F.sum("_d").alias("_sum"), F.count("*").alias("_n")).join(classes, "_class")
    costs = refs.join(maybe_broadcast(cut_lineage(found)), "_at").select("ref_feat", "_sum", "_n")
    return ref_feats.select(F.col("feat_id").alias("ref_feat")).join(costs, "ref_feat", "left").select(
        "ref_feat", (F.coalesce("_sum", F.lit(0)) + (n_seqs - F.coalesce("_n", F.lit(0))) * penalty).alias("cost"))


def best_anchor(ref_feats: DataFrame, feats: DataFrame, n_seqs: int, tol: float = 1000, penalty: float = 10000,
                allowed: Column | None = None) -> DataFrame:
    """Reference feature with the smallest total displacement."""
    if allowed is not None:
        ref_feats = ref_feats.filter(allowed)
    return anchor_costs(ref_feats, feats, n_seqs, tol, penalty).orderBy("cost", "ref_feat").limit(1)


def shift_to_anchor(feats: DataFrame, anchors: DataFrame) -> DataFrame:
    """Features moved so that each sequence's anchor sits where the reference has it.

    ``anchors(seq_id, anchor_start, ref_start)``; features pushed below 0 are dropped.
    """
    j = feats.join(anchors, "seq_id")
    moved = F.col("ref_start") - F.col("anchor_start")
    return j.withColumns({"start": F.col("start") + moved, "end": F.col("end") + moved}).filter("start >= 0").drop("anchor_start", "ref_start")


def gene_offset(genes: DataFrame, ref_genes: DataFrame) -> DataFrame:
    """Offset of each fragment to the reference: by its left-most gene that the reference has."""
    j = genes.join(ref_genes.select("gene", F.col("start").alias("_ref")), "gene")
    first = j.groupBy("seq_id").agg(F.min(F.struct("start", "gene", "_ref")).alias("f"))
    return first.select("seq_id", F.col("f.gene").alias("gene"), (F.col("f._ref") - F.col("f.start")).alias("offset"))


def subtype_counts(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    if keep:
        df = df.filter(F.col("subtype").isin(*keep))
    return df.groupBy("subtype").agg(F.count("*").alias("n"))


def assign_gene(scores: DataFrame, cut: float = 900) -> DataFrame:
    """Genes of each sequence scoring at least ``cut``; failing that its single best gene."""
    best = scores.groupBy("seq_id", "gene").agg(F.max("score").alias("score"))
    good = best.filter(F.col("score") >= cut)
    rest = best.join(good.select("seq_id").distinct(), "seq_id", "left_anti")
    top = rest.groupBy("seq_id").agg(F.max(F.struct("score", "gene")).alias("b")).select("seq_id", "b.gene", "b.score")
    return good.withColumn("confident", F.lit(True)).unionByName(top.withColumn("confident", F.lit(False)))


def assign_unique(scores: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment of reading frames to genes within each genome."""
    pairs = scores.withColumn("_cost", -F.col("score"))
    out = greedy_match(pairs, ["genome"], "orf", "gene", "_cost")
    return out.select("genome", "orf", "gene", (-F.col("_cost")).alias("score"))


def kmer_scores(index: DataFrame, ref_index: DataFrame) -> DataFrame:
    """Candidate (sequence, gene) scores: number of shared distinct words."""
    a = index.select("seq_id", "kmer").distinct()
    b = ref_index.select("gene", "kmer").distinct()
    return a.join(b, "kmer").groupBy("seq_id", "gene").agg(F.count("*").alias("score"))
