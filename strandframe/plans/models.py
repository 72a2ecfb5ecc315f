"""Queries that evaluate classifiers and compare clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.operators import models as ml, partitions as pt
from strandframe.plans.registry import query, table
from strandframe.plans.views import EXPR_SQL, MOTIFS, expr, seqs

REPS = 100


def _samples(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("cls"))


def _values(spark, d) -> DataFrame:
    return expr(spark, d).select("sample", F.col("gene").alias("feature"), "value")


_SPLIT = """smp AS (SELECT vec_id AS sample, label AS cls FROM embeddings), reps AS (SELECT unnest(range(100)) AS rep),
  rk AS (SELECT rep, sample, cls, row_number() OVER (PARTITION BY rep, cls ORDER BY md5(sample || '#' || rep || '#0'), sample) AS r, count(*) OVER (PARTITION BY rep, cls) AS n FROM smp, reps),
  lab AS (SELECT rep, sample, cls, r <= round(n * 2 / 3) AS is_train FROM rk)"""


@query("l1_stratified_splits", f"WITH {_SPLIT} SELECT rep, sample, cls FROM lab WHERE is_train")
def l1(spark, d):
    return ml.stratified_splits(_samples(spark, d), 2 / 3, REPS)


_DLDA = f"""WITH {EXPR_SQL}, {_SPLIT}, tr AS (SELECT rep, gene, cls = 1 AS own, value FROM expr JOIN lab USING (sample, cls) WHERE is_train),
  st AS (SELECT rep, gene, count(*) FILTER (own) AS n1, count(*) FILTER (NOT own) AS n0, avg(value) FILTER (own) AS m1, avg(value) FILTER (NOT own) AS m0, var_samp(value) FILTER (own) AS v1, var_samp(value) FILTER (NOT own) AS v0, avg(value) AS g FROM tr GROUP BY 1, 2),
  md AS (SELECT rep, gene, m1, m0, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS v, (n1 * pow(m1 - g, 2) + n0 * pow(m0 - g, 2)) / ((n1 - 1) * v1 + (n0 - 1) * v0) AS ratio FROM st),
  ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY ratio DESC, gene) AS rank FROM md) WHERE rank <= 20),
  sc AS (SELECT rep, nf AS n_features, sample, cls, sum(pow(value - m1, 2) / v) AS d1, sum(pow(value - m0, 2) / v) AS d0 FROM expr JOIN lab USING (sample, cls) JOIN ch USING (rep, gene), (SELECT unnest([5, 20]) AS nf) WHERE NOT is_train AND rank <= nf GROUP BY 1, 2, 3, 4)"""


def _dlda(spark, d, targets=None, m=(5, 20), reps=REPS) -> DataFrame:
    s = _samples(spark, d)
    packed = ml.pack_splits(s, ml.stratified_splits(s, 2 / 3, reps), reps)
    return ml.dlda(_values(spark, d), packed, list(m), targets=targets)


@query("l6_dlda", _DLDA + " SELECT rep, n_features, sample, cls, round(d0 / (d0 + d1), 7) AS score FROM sc")
def l6(spark, d):
    return _dlda(spark, d).select("rep", "n_features", "sample", "cls", F.round("score", 7).alias("score"))


@query("l7_one_vs_all")
def l7(spark, d):
    scores = _dlda(spark, d, targets=list(range(10)), m=(20,), reps=20)
    return ml.confusion(ml.one_vs_all(scores))


@query("l7_confusion", """SELECT lang AS cls, source AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang) + 1e-9, 2) AS share FROM documents GROUP BY 1, 2""")
def l7b(spark, d):
    return ml.confusion(table(spark, d, "documents").select(F.col("lang").alias("cls"), F.col("source").alias("predicted")))


@query("l8_evaluate_cohorts")
def l8(spark, d):
    s = _samples(spark, d).select("sample", (F.col("cls") < 5).cast("int").alias("cls"), (F.col("sample") % 3).alias("cohort"))
    return ml.evaluate_cohorts(_values(spark, d), s, [5, 20], REPS)


@query("l9_ablation")
def l9(spark, d):
    v = _values(spark, d)
    n = F.substring("feature", 2, 9).cast("int")
    s = _samples(spark, d)
    rules = {"half": s.select("sample", (F.col("cls") < 5).cast("int").alias("cls")), "odd": s.select("sample", (F.col("cls") % 2).alias("cls"))}
    return ml.ablation({"all": v, "low": v.filter(n < 32), "high": v.filter(n >= 32)}, rules, [10], 20)


def _patients(spark, d) -> dict[str, DataFrame]:
    from strandframe.operators.motifs import motif_count
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("pat"), "quality")
    counted = motif_count(seqs(spark, d), MOTIFS).select(F.col("seq_id").alias("pat"), F.col("motif").alias("feature"), F.col("n_hits").alias("value"))
    size = table(spark, d, "documents").select(F.col("doc_id").alias("pat"), F.lit("n_chars").alias("feature"), F.col("n_chars").alias("value"))
    return {"motif": counted.join(labels, "pat", "left_semi"), "size": size.join(labels, "pat", "left_semi")}


@query("l2_feature_table", """SELECT doc_id AS pat, 'size:n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'motif:the', CAST(len(regexp_extract_all(lower(text), 'the')) AS DOUBLE) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def l2(spark, d):
    blocks = _patients(spark, d)
    blocks["motif"] = blocks["motif"].filter("feature = 'the'")
    return ml.feature_table(blocks)


def _wide(spark, d) -> DataFrame:
    names = [n for n, _ in MOTIFS]
    f = ml.feature_table(_patients(spark, d))
    wide = f.groupBy("pat").agg(*[F.max(F.when(F.col("feature") == f"motif:{n}", F.col("value"))).alias(n) for n in names],
                                F.max(F.when(F.col("feature") == "size:n_chars", F.col("value"))).alias("n_chars"))
    return wide.join(table(spark, d, "labels").select(F.col("doc_id").alias("pat"), F.col("quality").cast("double").alias("resp")), "pat")


@query("l2_complete_features")
def l2b(spark, d):
    f = ml.feature_table(_patients(spark, d))
    return ml.complete_features(f, f.select("pat").distinct()).groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("l3_stepwise")
def l3(spark, d):
    names = [n for n, _ in MOTIFS] + ["n_chars"]
    steps = ml.stepwise(_wide(spark, d), names, "resp", enter=0.5)
    return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(steps)], "step int, feature string, p double")


@query("l3_stepwise_search")
def l3b(spark, d):
    return ml.stepwise_search(_vectors(spark, d).withColumn("cls", (F.col("cls") < 5).cast("int")))


@query("l4_glm_eval")
def l4(spark, d):
    w = _wide(spark, d)
    held = F.conv(F.substring(F.md5(F.col("pat").cast("string")), 1, 1), 16, 10).cast("int") >= 11
    _, areas = ml.glm_eval(w.filter(~held), w.filter(held), [n for n, _ in MOTIFS], "resp")
    return areas


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("cls"), F.col("embedding").cast("array<double>").alias("vec"))


_VOTE = f"""WITH {_SPLIT}, e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, is_train FROM embeddings JOIN lab ON vec_id = sample AND rep = 0), p AS (SELECT a.vec_id AS sample, b.vec_id AS neighbour, b.label AS cls,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM e a JOIN e b ON NOT a.is_train AND b.is_train)"""


def _held_out(spark, d) -> tuple[DataFrame, DataFrame]:
    """Training and test vectors of one stratified split."""
    v = _vectors(spark, d)
    train = ml.stratified_splits(_samples(spark, d), 2 / 3, 1).select("sample")
    return v.join(train, "sample", "left_semi"), v.join(train, "sample", "left_anti")


@query("l5_knn", _VOTE + """, v AS (SELECT sample, k, cls, count(*) AS c FROM p, (SELECT unnest([1, 5, 15]) AS k) WHERE rank <= k GROUP BY 1, 2, 3)
  SELECT sample, k, cls AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY sample, k ORDER BY c DESC, cls) AS r FROM v) WHERE r = 1""")
def l5(spark, d):
    train, test = _held_out(spark, d)
    return ml.knn_vote(ml.knn(train, test.drop("cls"), 15), [1, 5, 15])


#: Two classes: label 0 to 4 or not. Distances are summed feature by feature in order of rank.
_SEARCH = f"""WITH {_SPLIT}, tr AS (SELECT vec_id AS sample, CAST(label < 5 AS INTEGER) AS cls, embedding FROM embeddings JOIN lab ON vec_id = sample AND rep = 0 AND is_train),
  x AS (SELECT sample, cls, f, CAST(embedding[f + 1] AS DOUBLE) AS v FROM tr, range(64) r(f)),
  c AS (SELECT f, v, count(*) FILTER (cls = 1) AS p, count(*) FILTER (cls <> 1) AS n FROM x GROUP BY 1, 2),
  u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
  o AS (SELECT f, row_number() OVER (ORDER BY round(abs(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) - 0.5), 12) DESC, f) AS pos FROM u GROUP BY f),
  y AS (SELECT sample, cls, list(v ORDER BY pos) AS v FROM x JOIN o USING (f) GROUP BY 1, 2),
  inn AS (SELECT rep, sample, cls, v, ('0x' || substr(md5(sample || '#' || rep), 1, 7))::BIGINT % 10 = 0 AS out FROM y, range(20) q(rep)),
  near AS (SELECT a.rep, nf, a.sample, a.cls, b.cls AS other, row_number() OVER (PARTITION BY a.rep, nf, a.sample ORDER BY list_distance(a.v[1:nf], b.v[1:nf]), b.sample) AS rank
    FROM inn a JOIN inn b ON a.rep = b.rep AND a.out AND NOT b.out, (SELECT unnest(range(1, 65)) AS nf)),
  run AS (SELECT rep, nf, sample, cls, first(other ORDER BY rank) AS top, coalesce(min(rank) FILTER (other <> t1) - 1, 30) AS agreed
    FROM (SELECT *, first_value(other) OVER (PARTITION BY rep, nf, sample ORDER BY rank) AS t1 FROM near WHERE rank <= 30) GROUP BY 1, 2, 3, 4),
  g AS (SELECT nf, k, count(*) FILTER (agreed >= k) AS classified, count(*) FILTER (agreed >= k AND top = cls) AS correct FROM run, (SELECT unnest(range(1, 31)) AS k) GROUP BY 1, 2),
  r AS (SELECT *, CASE WHEN classified > 0 THEN correct / classified ELSE 0 END AS rate FROM g),
  s AS (SELECT *, nf > 10 AND (rate - lag(rate, 4) OVER (PARTITION BY k ORDER BY nf)) / 4 < 1e-5 AS still FROM r),
  e AS (SELECT *, min(nf) FILTER (still) OVER (PARTITION BY k) AS last FROM s)
  SELECT CAST(nf AS INTEGER) AS n_features, CAST(k AS INTEGER) AS k, classified, correct, round(rate, 9) AS rate, row_number() OVER (ORDER BY rate DESC, k, nf) = 1 AS chosen FROM e WHERE last IS NULL OR nf <= last"""


@query("l5_knn_search", _SEARCH)
def l5b(spark, d):
    train, _ = _held_out(spark, d)
    return ml.knn_search(train.withColumn("cls", (F.col("cls") < 5).cast("int"))).withColumn("rate", F.round("rate", 9))


def _runs(spark, d) -> DataFrame:
    """Partitions of the parts by several of their own columns."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample"), "p_type", "p_brand", "p_size")
    runs = F.array(F.struct(F.lit(0).alias("run"), F.col("p_type").alias("cluster")), F.struct(F.lit(1).alias("run"), F.col("p_brand").alias("cluster")),
                   F.struct(F.lit(2).alias("run"), F.col("p_size").cast("string").alias("cluster")))
    return p.select("sample", F.inline(runs))


_RUNS = """runs AS (SELECT p_partkey AS sample, 0 AS run, p_type AS cluster FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part UNION ALL SELECT p_partkey, 2, CAST(p_size AS VARCHAR) FROM part)"""


@query("l10_kmeans_coassociation")
def l10(spark, d):
    runs = pt.kmeans_runs(_vectors(spark, d), 10, 3)
    return pt.sample_coassociation(runs, 3)


@query("l10_coassociation", f"WITH {_RUNS} SELECT x.sample AS a, y.sample AS b, round(count(*) / 3, 6) AS similarity FROM runs x JOIN runs y ON x.run = y.run AND x.cluster = y.cluster AND x.sample < y.sample GROUP BY 1, 2 HAVING count(*) >= 2")
def l10b(spark, d):
    co = pt.sample_coassociation(_runs(spark, d), 3).filter("similarity > 0.5")
    return co.withColumn("similarity", F.round("similarity", 6))


@query("l11_coassociation_from_trace", f"""WITH {_RUNS} SELECT x.sample AS a, y.sample AS b, round(count(*) / 2, 6) AS similarity FROM runs x JOIN runs y ON x.run = y.run AND x.cluster = y.cluster AND x.sample < y.sample WHERE x.run IN (1, 2) GROUP BY 1, 2 HAVING count(*) = 2""")
def l11(spark, d):
    r = _runs(spark, d)
    # chain 0 has its better partition at iteration 1, chain 1 at iteration 2
    parts = r.select(F.when(F.col("run") == 2, 1).otherwise(0).alias("chain"), F.col("run").alias("iter"), "sample", "cluster")
    trace = parts.groupBy("chain", "iter").agg(F.countDistinct("cluster").cast("double").alias("loglik"))
    co = pt.coassociation_from_trace(parts, trace).filter("similarity > 0.9")
    return co.withColumn("similarity", F.round("similarity", 6))


@query("l12_outliers", f"""WITH {_RUNS}, co AS (SELECT x.sample AS a, y.sample AS b FROM runs x JOIN runs y ON x.run = y.run AND x.cluster = y.cluster AND x.sample <> y.sample GROUP BY 1, 2 HAVING count(*) / 3 > 0.5)
  SELECT p_partkey AS sample FROM part WHERE p_partkey NOT IN (SELECT a FROM co)""")
def l12(spark, d):
    return pt.outliers(_runs(spark, d), 3)


@query("l13_gap_statistic")
def l13(spark, d):
    return pt.gap_statistic(_vectors(spark, d))


@query("l13_dispersion", """WITH v AS (SELECT vec_id AS sample, CAST(embedding AS DOUBLE[]) AS v, k, label % k AS cluster FROM embeddings, (SELECT unnest([2, 5, 10]) AS k))
  SELECT a.k, round(ln(sum(list_distance(a.v, b.v)) / 128), 6) AS log_w FROM v a JOIN v b ON a.k = b.k AND a.cluster = b.cluster AND a.sample < b.sample GROUP BY 1""")
def l13b(spark, d):
    v = _vectors(spark, d)
    blocks = pt.point_blocks(v, 0, block=4096)
    cls = v.select("sample", F.col("cls"), F.explode(F.array(F.lit(2), F.lit(5), F.lit(10))).alias("k"))
    of = blocks.select("b", "part", F.posexplode("ids").alias("pos", "sample")).join(cls, "sample")
    labels = of.groupBy("b", "part", "k").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("cls") % F.col("k")).alias("cluster")))).alias("l")).select("b", "part", "k", F.col("l.cluster").alias("labels"))
    return pt.dispersion(blocks, labels).select("k", F.round("log_w", 6).alias("log_w"))


_PAIRS = """cells AS (SELECT p_type AS c0, p_brand AS c1, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2) AS ss, sum(n) AS n FROM cells), a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM cells GROUP BY c0)),
  b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM cells GROUP BY c1)), pc AS (SELECT CAST(ss AS DOUBLE) AS nss, CAST(a - ss AS DOUBLE) AS nsd, CAST(b - ss AS DOUBLE) AS nds, CAST(n * (n - 1) / 2 - a - b + ss AS DOUBLE) AS ndd FROM t, a, b)"""


def _pair_counts(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return pt.pair_counts(p.select(F.col("p_partkey").alias("sample"), F.col("p_type").alias("cluster")), p.select(F.col("p_partkey").alias("sample"), F.col("p_brand").alias("cluster")))


@query("l14_pair_counts", f"WITH {_PAIRS} SELECT nss, nsd, nds, ndd FROM pc")
def l14(spark, d):
    return _pair_counts(spark, d)


@query("l14_agreement", f"""WITH {_PAIRS} SELECT round(nss / (nss + nsd + nds), 9) AS jaccard, round((nss - (nss + nsd) * (nss + nds) / (nss + nsd + nds + ndd)) / ((nss + nsd + nss + nds) / 2 - (nss + nsd) * (nss + nds) / (nss + nsd + nds + ndd)), 9) AS ari,
  round((nsd + nds) / (nss + nsd + nds + ndd), 9) AS distance FROM pc""")
def l14b(spark, d):
    out = pt.pair_distance(pt.ari(pt.jaccard(_pair_counts(spark, d))))
    return out.select(*[F.round(c, 9).alias(c) for c in ("jaccard", "ari", "distance")])


@query("l15_medoid_partition", f"""WITH {_RUNS}, cells AS (SELECT x.run AS i, y.run AS j, x.cluster AS c0, y.cluster AS c1, count(*) AS n FROM runs x JOIN runs y ON x.sample = y.sample AND x.run < y.run GROUP BY 1, 2, 3, 4),
  jn AS (SELECT i, j, sum(n * (n - 1) / 2) AS ss, sum(n) AS n FROM cells GROUP BY 1, 2), w AS (SELECT run, sum(n * (n - 1) / 2) AS w FROM (SELECT run, cluster, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1),
  ds AS (SELECT i, j, (a.w + b.w - 2 * ss) / (n * (n - 1) / 2) AS dist FROM jn JOIN w a ON a.run = i JOIN w b ON b.run = j), al AS (SELECT i AS iter, dist FROM ds UNION ALL SELECT j, dist FROM ds)
  SELECT iter, round(avg(dist * dist), 9) AS mean_sq FROM al GROUP BY 1 ORDER BY mean_sq, iter LIMIT 1""")
def l15(spark, d):
    return pt.medoid_partition(_runs(spark, d).withColumnRenamed("run", "iter")).withColumn("mean_sq", F.round("mean_sq", 9))


@query("l16_relabel_by_size", """SELECT p_partkey AS sample, p_brand AS cluster, CAST(label AS INTEGER) AS label FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS label FROM part GROUP BY 1) USING (p_brand)""")
def l16(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample"), F.col("p_brand").alias("cluster"))
    return pt.relabel_by_size(p).select("sample", "cluster", "label")
