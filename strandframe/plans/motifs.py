"""Queries that search documents, read as sequences, for motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.functions import scalars as sc
from strandframe.operators import bins as bn, motifs as mt, pwm as pw
from strandframe.operators.joins import range_join
from strandframe.plans.registry import query, table
from strandframe.plans.views import MOTIFS, SEQS_SQL, seqs
from strandframe.session import spread

_MOTIF_ROWS = ", ".join(f"('{n}', '{r}')" for n, r in MOTIFS)
_MOTIFS_SQL = f"motifs(motif, regex) AS (VALUES {_MOTIF_ROWS})"

#: Every position of every sequence with the four letters from there on.
_CHARS = SEQS_SQL + """, chars AS (SELECT seq_id, unnest(l) AS c, unnest(range(len(l))) AS start
  FROM (SELECT seq_id, string_split(seq, '') AS l FROM seqs) WHERE len(l) > 0)"""
_WINDOWS = _CHARS + """, win AS MATERIALIZED (SELECT seq_id, CAST(start AS INTEGER) AS start, c, coalesce(lead(c, 1) OVER w, '') AS c1, coalesce(lead(c, 2) OVER w, '') AS c2,
  coalesce(lead(c, 3) OVER w, '') AS c3 FROM chars WINDOW w AS (PARTITION BY seq_id ORDER BY start))"""
_PLACES = {
    "tion": ("c = 't' AND c1 = 'i' AND c2 = 'o' AND c3 = 'n'", 4),
    "vowel3": ("c IN ('a','e','i','o','u') AND c1 IN ('a','e','i','o','u') AND c2 IN ('a','e','i','o','u')", 3),
    "the": ("c = 't' AND c1 = 'h' AND c2 = 'e'", 3),
    "s_s": ("c = 's' AND c1 NOT IN ('', chr(10)) AND c2 = 's'", 3),
    "en_dt": ("c = 'e' AND c1 = 'n' AND c2 IN ('d', 't')", 3),
    "not_h": ("c = 't' AND c1 NOT IN ('', 'h', 'o') AND c2 = 'e'", 3),
}
_HITS = _WINDOWS + ", " + _MOTIFS_SQL + ", hits AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT seq_id, '{n}' AS motif, start, CAST(start + {w} AS INTEGER) AS "end", c || c1 || c2{" || c3" if w == 4 else ""} AS match FROM win WHERE {cond}"""
    for n, (cond, w) in _PLACES.items()) + ")"


def _hits(spark, d) -> DataFrame:
    return mt.scan_motifs(seqs(spark, d), MOTIFS)


@query("flagship_motif_counts", f"""WITH {_HITS} SELECT seq_id, motif, count(*) AS n_hits, min(start) AS first_start, max("end") AS last_end
  FROM hits GROUP BY 1, 2""")
def flagship(spark, d):
    """Motif hits of every document: scan, then one row per document and motif."""
    return _hits(spark, d).groupBy("seq_id", "motif").agg(
        F.count("*").alias("n_hits"), F.min("start").alias("first_start"), F.max("end").alias("last_end")
    ).orderBy(F.desc("n_hits"), "seq_id", "motif")


@query("m1_scan_motifs", f'WITH {_HITS} SELECT seq_id, motif, start, "end", match FROM hits')
def m1(spark, d):
    return _hits(spark, d)


@query("m1_scan_motif_table", f'WITH {_HITS} SELECT motif, count(*) AS n_hits, CAST(sum(start) AS BIGINT) AS sum_start FROM hits GROUP BY 1')
def m1b(spark, d):
    dictionary = spark.createDataFrame(MOTIFS, "name string, regex string")
    return mt.scan_motifs(seqs(spark, d), dictionary).groupBy("motif").agg(F.count("*").alias("n_hits"), F.sum("start").alias("sum_start"))


@query("m2_scan_plain", f"""WITH {SEQS_SQL}, {_MOTIFS_SQL}, found AS (SELECT seq_id, motif, regexp_extract_all(seq, regex) AS m FROM seqs, motifs)
  SELECT seq_id, motif, CAST(len(m) AS BIGINT) AS n_hits, CAST(length(array_to_string(m, '')) AS BIGINT) AS n_letters FROM found WHERE len(m) > 0""")
def m2(spark, d):
    hits = mt.scan_motifs(seqs(spark, d), MOTIFS, overlap=False, ignore_case=True)
    return hits.groupBy("seq_id", "motif").agg(F.count("*").alias("n_hits"), F.sum(F.length("match")).alias("n_letters"))


@query("m3_motif_count", f"""WITH {_HITS} SELECT s.seq_id, m.motif, coalesce(n, 0) AS n_hits, n IS NOT NULL AS present FROM seqs s CROSS JOIN motifs m
  LEFT JOIN (SELECT seq_id, motif, count(*) AS n FROM hits GROUP BY 1, 2) h ON h.seq_id = s.seq_id AND h.motif = m.motif""")
def m3(spark, d):
    return mt.motif_count(seqs(spark, d), MOTIFS)


@query("m3_motif_count_range", f"""WITH {_HITS} SELECT s.seq_id, m.motif, coalesce(n, 0) AS n_hits, n IS NOT NULL AS present FROM seqs s CROSS JOIN motifs m
  LEFT JOIN (SELECT seq_id, motif, count(*) AS n FROM hits WHERE start BETWEEN 100 AND 400 GROUP BY 1, 2) h ON h.seq_id = s.seq_id AND h.motif = m.motif""")
def m3b(spark, d):
    return mt.motif_count(seqs(spark, d), MOTIFS, 100, 400)


@query("m4_motif_array", f"""WITH {_HITS} SELECT seq_id, motif, array_to_string(list_transform(range(0, 41), lambda p: CASE WHEN list_contains(s, p) THEN '1' ELSE '0' END), '') AS presence
  FROM (SELECT a.seq_id, m.motif, coalesce(s, []) AS s FROM seqs a CROSS JOIN (SELECT DISTINCT motif FROM motifs) m
    LEFT JOIN (SELECT seq_id, motif, list(start) AS s FROM hits WHERE start BETWEEN 0 AND 40 GROUP BY 1, 2) h ON h.seq_id = a.seq_id AND h.motif = m.motif)""")
def m4(spark, d):
    return mt.motif_array(_hits(spark, d), 0, 40, seqs(spark, d), [n for n, _ in MOTIFS]).withColumn("presence", F.array_join("presence", ""))


@query("m5_add_motif", f"""WITH {_HITS} SELECT motif, count(*) AS n_hits FROM hits GROUP BY 1
  UNION ALL SELECT 'er_', count(*) FROM win WHERE c || c1 || c2 = 'er '""")
def m5(spark, d):
    s = seqs(spark, d)
    return mt.add_motif(mt.scan_motifs(s, MOTIFS), s, "er_", "er ").groupBy("motif").agg(F.count("*").alias("n_hits"))


@query("m6_motif_totals", f"WITH {_HITS} SELECT motif, count(*) AS n_hits FROM hits WHERE start BETWEEN 10 AND 500 GROUP BY 1")
def m6(spark, d):
    return mt.MotifFrame(seqs(spark, d), MOTIFS).motif_totals(10, 500)


_EDGES = [0, 250, 500, 1000, 2000, 4000]
#: The last bin ends where the longest sequence does.
_BIN_ROWS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))
_LAST = f"({len(_EDGES) - 1}, {_EDGES[-1]}, (SELECT CAST(greatest(max(length(text)), {_EDGES[-1] + 1}) AS INTEGER) FROM documents))"
_BINS = f"bins AS (SELECT motif, bin_id, lo, hi FROM motifs, (VALUES {_BIN_ROWS}, {_LAST}) b(bin_id, lo, hi))"


def _longest(spark, d) -> int:
    """Letters of the longest sequence."""
    return seqs(spark, d).agg(F.max(F.length("seq"))).first()[0] or 0


def _bins(spark, d, motifs=tuple(n for n, _ in MOTIFS)) -> DataFrame:
    edges = [*_EDGES, max(_longest(spark, d), _EDGES[-1] + 1)]
    names = spark.createDataFrame([(n, edges) for n in motifs], "motif string, edges array<int>")
    return bn.edges_to_bins(names, ["motif"])


@query("m7_binned_presence", f"""WITH {_HITS}, {_BINS} SELECT seq_id, h.motif, bin_id, count(*) AS n_hits FROM hits h
  JOIN bins b ON h.motif = b.motif AND start >= lo AND start < hi GROUP BY 1, 2, 3""")
def m7(spark, d):
    return mt.binned_presence(_hits(spark, d), _bins(spark, d))


@query("m8_bin_quality", f"""WITH {_HITS}, {_BINS}, per AS (SELECT b.motif, b.bin_id, seq_id, count(*) AS n FROM hits h
  JOIN bins b ON h.motif = b.motif AND start >= lo AND start < hi GROUP BY 1, 2, 3),
  q AS (SELECT b.motif, b.bin_id, lo, hi, count(CASE WHEN n = 1 THEN 1 END) AS n_one, count(CASE WHEN n > 1 THEN 1 END) AS n_more
    FROM bins b LEFT JOIN per p ON p.motif = b.motif AND p.bin_id = b.bin_id GROUP BY 1, 2, 3, 4),
  e AS (SELECT *, (SELECT count(*) FROM seqs) - n_one - n_more AS n_empty FROM q)
  SELECT *, round((0.25 * n_empty + n_more) / (n_one + 1), 9) AS cost FROM e""")
def m8(spark, d):
    s = seqs(spark, d)
    return bn.bin_quality(_hits(spark, d), _bins(spark, d), s.count()).withColumn("cost", F.round("cost", 9))


@query("m9_optimise_bins")
def m9(spark, d):
    s = seqs(spark, d)
    out = bn.optimise_bins(_hits(spark, d), s.count(), _longest(spark, d), forced=[1000, 2500], max_rounds=12)
    return out.withColumn("edges", F.concat_ws(",", F.col("edges").cast("array<string>")))


@query("m10_window_bins")
def m10(spark, d):
    s = seqs(spark, d)
    out = bn.window_bins(_hits(spark, d), s.count(), max_ratio=0.9)
    return out.withColumn("edges", F.concat_ws(",", F.col("edges").cast("array<string>")))


@query("m11_kmeans_bins")
def m11(spark, d):
    s = seqs(spark, d)
    return bn.kmeans_bins(_hits(spark, d), s.count(), k=4)


# With two clusters the best border is the one after which the squared sums over the counts are largest.
@query("m11_two_bins", f"""WITH {_HITS}, often AS (SELECT motif FROM (SELECT DISTINCT motif, seq_id FROM hits) GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM documents)),
  mass AS (SELECT motif, start AS x, count(*) AS n FROM hits JOIN often USING (motif) GROUP BY 1, 2),
  sums AS (SELECT motif, x, CAST(sum(n) OVER w AS DOUBLE) AS n1, CAST(sum(n * x) OVER w AS DOUBLE) AS s1, CAST(sum(n) OVER (PARTITION BY motif) AS DOUBLE) AS n2, CAST(sum(n * x) OVER (PARTITION BY motif) AS DOUBLE) AS s2,
    min(x) OVER (PARTITION BY motif) AS first, max(x) OVER (PARTITION BY motif) AS last FROM mass WINDOW w AS (PARTITION BY motif ORDER BY x)),
  best AS (SELECT motif, first, last, CAST(ceil((s1 / n1 + (s2 - s1) / (n2 - n1)) / 2) AS INTEGER) AS border FROM sums WHERE x < last
    QUALIFY row_number() OVER (PARTITION BY motif ORDER BY s1 * s1 / n1 + (s2 - s1) * (s2 - s1) / (n2 - n1) DESC, x) = 1)
  SELECT motif, 0 AS bin_id, first AS lo, border AS hi FROM best UNION ALL SELECT motif, 1, border, last + 1 FROM best""")
def m11_two(spark, d):
    return bn.kmeans_bins(_hits(spark, d), seqs(spark, d).count(), k=2)


_TURNED = SEQS_SQL + """, turned AS (SELECT seq_id, 'forward' AS orientation, seq AS s FROM seqs UNION ALL SELECT seq_id, 'reverse', reverse(seq) FROM seqs
  UNION ALL SELECT seq_id, 'complement', translate(seq, 'acgt', 'tgca') FROM seqs UNION ALL SELECT seq_id, 'reverse_complement', reverse(translate(seq, 'acgt', 'tgca')) FROM seqs),
  tchars AS (SELECT seq_id, orientation, n, unnest(l) AS c, unnest(range(len(l))) AS start FROM (SELECT seq_id, orientation, length(s) AS n, string_split(s, '') AS l FROM turned)),
  twin AS (SELECT seq_id, orientation, n, CAST(start AS INTEGER) AS start, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3
    FROM tchars WINDOW w AS (PARTITION BY seq_id, orientation ORDER BY start))"""


@query("p3_orientations", f"""WITH {_TURNED} SELECT seq_id, orientation, md5(s) AS digest FROM turned""")
def p3(spark, d):
    return sc.orientations(seqs(spark, d)).select("seq_id", "orientation", F.md5("seq").alias("digest"))


@query("m12_fuzzy_scan", f"""WITH {_TURNED}, f AS (SELECT *, CAST(c <> 't' AS INTEGER) + CAST(c1 <> 'h' AS INTEGER) + CAST(c2 NOT IN ('e', 'a') AS INTEGER) + CAST(c3 <> 'n' AS INTEGER) AS mm FROM twin WHERE c3 IS NOT NULL)
  SELECT orientation, mm AS mismatches, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start,
    CAST(sum(CASE WHEN orientation IN ('reverse', 'reverse_complement') THEN start ELSE n - start END) AS BIGINT) AS sum_to_end FROM f WHERE mm <= 1 GROUP BY 1, 2""")
def m12(spark, d):
    hits = mt.fuzzy_scan(seqs(spark, d), "th[ea]n", 1)
    return hits.groupBy("orientation", "mismatches").agg(
        F.count("*").alias("n"), F.sum("start").alias("sum_start"), F.sum("to_end").alias("sum_to_end"))


@query("m13_closest_match", f"""WITH {_TURNED}, f AS (SELECT *, CAST(c <> 's' AS INTEGER) + CAST(c1 <> 'h' AS INTEGER) + CAST(c2 <> 'e' AS INTEGER) + CAST(c3 <> 'n' AS INTEGER) AS mm FROM twin WHERE c3 IS NOT NULL),
  b AS (SELECT *, min(mm) OVER (PARTITION BY seq_id, orientation) AS best FROM f)
  SELECT seq_id, orientation, mm AS mismatches, count(*) AS n_ties, min(start) AS first_start FROM b WHERE mm = best GROUP BY 1, 2, 3""")
def m13(spark, d):
    ties = mt.closest_match(seqs(spark, d), "shen")
    return ties.groupBy("seq_id", "orientation", "mismatches").agg(F.count("*").alias("n_ties"), F.min("start").alias("first_start"))


@query("m14_first_pos", f"""WITH {SEQS_SQL} SELECT seq_id, pattern, CAST(strpos(seq, pattern) AS INTEGER) AS position FROM seqs, (VALUES ('tion'), ('qu'), ('then')) p(pattern)""")
def m14(spark, d):
    return mt.first_pos(seqs(spark, d), ["tion", "qu", "then"])


@query("m15_neighbour_search", f"""WITH {SEQS_SQL}, letters AS (SELECT unnest(['a', 'e', 'h', 'n', 't']) AS x),
  words AS (SELECT 'hen' AS pattern UNION SELECT x || 'en' FROM letters UNION SELECT 'h' || x || 'n' FROM letters UNION SELECT 'he' || x FROM letters)
  SELECT seq_id, pattern, CAST(strpos(seq, pattern) AS INTEGER) AS position FROM seqs, words WHERE strpos(seq, pattern) > 0""")
def m15(spark, d):
    return mt.neighbour_search(seqs(spark, d), "hen", 1, "aehnt")


_RULES = [("r1", "the[nr]", "th[^e]n"), ("r2", "qu[ei]", "que"), ("r3", "zz", "tion")]


@query("m16_call_sites", f"""WITH {SEQS_SQL}, rules(rule, wild, mutant) AS (VALUES {", ".join(str(r) for r in _RULES)}),
  found AS (SELECT seq_id, rule, regexp_extract(seq, wild) AS w, regexp_extract(seq, mutant) AS m, seq FROM seqs, rules)
  SELECT seq_id, rule, CAST(CASE WHEN w <> '' THEN strpos(seq, w) ELSE strpos(seq, m) END - 1 AS INTEGER) AS start,
  CAST(CASE WHEN w <> '' THEN strpos(seq, w) + length(w) ELSE strpos(seq, m) + length(m) END - 1 AS INTEGER) AS "end", w <> '' AS is_wild FROM found WHERE w <> '' OR m <> ''""")
def m16(spark, d):
    return mt.call_sites(seqs(spark, d), _RULES)


@query("m17_pwm_from_seqs", f"""WITH {_HITS}, h AS (SELECT motif AS pwm_id, match FROM hits),
  t AS (SELECT pwm_id, count(*) AS total FROM h GROUP BY 1),
  l AS (SELECT pwm_id, p AS "offset", match[p + 1] AS symbol FROM h, (SELECT unnest([0, 1, 2, 3]) AS p) WHERE p < length(match))
  SELECT pwm_id, "offset", symbol, round(count(*) / max(total), 9) AS weight FROM l JOIN t USING (pwm_id) GROUP BY 1, 2, 3""")
def m17(spark, d):
    aligned = _hits(spark, d).select(F.col("motif").alias("pwm_id"), F.col("match").alias("seq"))
    return pw.pwm_from_seqs(aligned).withColumn("weight", F.round("weight", 9))


def _pwm(spark) -> DataFrame:
    return pw.pwm_from_regex(spark, [("en_dt", "en[dt]"), ("thx", "t(?:h|r)[aeio]")], "abcdefghijklmnopqrstuvwxyz ")


_SCORES = _WINDOWS + """, scores AS (
  SELECT seq_id, 'en_dt' AS pwm_id, start, CAST(c = 'e' AS INTEGER) + CAST(c1 = 'n' AS INTEGER) + 0.5 * CAST(c2 IN ('d', 't') AS INTEGER) AS score FROM win WHERE c2 <> ''
  UNION ALL SELECT seq_id, 'thx', start, CAST(c = 't' AS INTEGER) + 0.5 * CAST(c1 IN ('h', 'r') AS INTEGER) + 0.25 * CAST(c2 IN ('a', 'e', 'i', 'o') AS INTEGER) FROM win WHERE c2 <> '')"""


def _scores(spark, d) -> DataFrame:
    return pw.pwm_scan(seqs(spark, d), _pwm(spark), missing=0.0)


@query("m18_m19_pwm_scan", f"""WITH {_SCORES} SELECT seq_id, pwm_id, count(*) AS n, CAST(sum(score) AS DOUBLE) AS total, CAST(max(score) AS DOUBLE) AS top FROM scores GROUP BY 1, 2""")
def m19(spark, d):
    return _scores(spark, d).groupBy("seq_id", "pwm_id").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("top"))


@query("m20_pwm_best", f"""WITH {_SCORES} SELECT seq_id, pwm_id, CAST(score AS DOUBLE) AS score, start FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, pwm_id ORDER BY score DESC, start) AS r FROM scores) WHERE r = 1""")
def m20(spark, d):
    return pw.pwm_best(_scores(spark, d), ["seq_id"])


@query("m21_empirical_p", f"""WITH {_SCORES}, best AS (SELECT seq_id, pwm_id, sum(score) / count(*) AS score FROM scores GROUP BY 1, 2),
  cnt AS (SELECT pwm_id, score, count(*) AS n FROM scores GROUP BY 1, 2), tot AS (SELECT pwm_id, count(*) AS n FROM scores GROUP BY 1)
  SELECT b.seq_id, b.pwm_id, round(greatest((SELECT coalesce(sum(n), 0) FROM cnt c WHERE c.pwm_id = b.pwm_id AND c.score > b.score) / t.n, 1 / t.n), 9) AS p
  FROM best b JOIN tot t USING (pwm_id)""")
def m21(spark, d):
    from strandframe.session import cut_lineage
    null = cut_lineage(_scores(spark, d).groupBy("seq_id", "pwm_id", "score").agg(F.count("*").alias("n")))  # equal scores of a sequence are one row
    asked = null.groupBy("seq_id", "pwm_id").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"))
    return pw.empirical_p(asked, null, times="n").select("seq_id", "pwm_id", F.round("p", 9).alias("p"))


@query("m22_pwm_binned_max", f"""WITH {_SCORES}, bins(motif, bin_id, lo, hi) AS (SELECT m, bin_id, lo, hi FROM (VALUES ('en_dt'), ('thx')) a(m), (VALUES {_BIN_ROWS}, {_LAST}) b(bin_id, lo, hi))
  SELECT seq_id, motif, bin_id, CAST(max(score) AS DOUBLE) AS score FROM scores JOIN bins ON pwm_id = motif AND start >= lo AND start < hi GROUP BY 1, 2, 3""")
def m22(spark, d):
    return pw.pwm_binned_max(_scores(spark, d), _bins(spark, d, ("en_dt", "thx")))


@query("m23_pwm_objective", f"""WITH {_SCORES} SELECT pwm_id, round(avg(CASE WHEN NOT hit THEN score END) / avg(CASE WHEN hit THEN score END), 9) AS ratio FROM
  (SELECT s.*, s.pwm_id = 'en_dt' AND score = 2.5 AS hit FROM scores s) GROUP BY 1""")
def m23(spark, d):
    hits = mt.scan_motifs(seqs(spark, d), [("en_dt", "en[dt]")])
    return pw.pwm_objective(pw.pwm_scan(seqs(spark, d), _pwm(spark), missing=0.0, hits=hits)).withColumn("ratio", F.round("ratio", 9))


@query("m24_containment", f"""WITH {SEQS_SQL} SELECT probe, CAST(sum(CAST(contains(seq, probe) AS INTEGER)) AS BIGINT) AS n_with, round(avg(CAST(contains(seq, probe) AS INTEGER)), 9) AS share
  FROM seqs, (VALUES ('tion'), ('zzz'), ('license')) p(probe) GROUP BY 1""")
def m24(spark, d):
    return mt.containment(seqs(spark, d), ["tion", "zzz", "license"]).withColumn("share", F.round("share", 9))


@query("m25_find_islands", f"""WITH {_WINDOWS} SELECT seq_id, 'ana' AS motif, start, CAST(start + 3 AS INTEGER) AS "end" FROM win WHERE c || c1 || c2 = 'ana'
  UNION ALL SELECT seq_id, 'dot', start, CAST(start + 2 AS INTEGER) FROM win WHERE c || c1 = '. '""")
def m25(spark, d):
    return mt.find_islands(seqs(spark, d), [("ana", "ana"), ("dot", ". ")]).drop("match")


@query("m26_kmer_index", f"""WITH {_WINDOWS} SELECT c || c1 || c2 || c3 AS kmer, count(*) AS n, count(DISTINCT seq_id) AS n_seqs FROM win WHERE c3 <> '' GROUP BY 1""")
def m26(spark, d):
    return mt.kmer_index(seqs(spark, d), 4).groupBy("kmer").agg(F.count("*").alias("n"), F.countDistinct("seq_id").alias("n_seqs"))


@query("m26_kmer_lookup", f"""WITH {_WINDOWS}, k AS (SELECT seq_id, start, c || c1 || c2 || c3 AS kmer FROM win WHERE c3 <> '')
  SELECT seq_id, start, kmer, CAST((kmer[1] <> 't') AS INTEGER) + CAST((kmer[2] <> 'h') AS INTEGER) + CAST((kmer[3] <> 'e') AS INTEGER) + CAST((kmer[4] <> 'n') AS INTEGER) AS mismatches
  FROM k WHERE regexp_matches(kmer, '^[aehnt]{{4}}$') AND CAST((kmer[1] <> 't') AS INTEGER) + CAST((kmer[2] <> 'h') AS INTEGER) + CAST((kmer[3] <> 'e') AS INTEGER) + CAST((kmer[4] <> 'n') AS INTEGER) <= 1""")
def m26b(spark, d):
    queries = spark.createDataFrame([("then",)], "query string")
    return mt.kmer_lookup(mt.kmer_index(seqs(spark, d), 4), queries, 1, "aehnt").select("seq_id", "start", "kmer", "mismatches")


@query("m28_best_hit", """SELECT l_suppkey AS seq_id, p_brand AS name, min(l_discount) AS p_val, min(l_discount) < 0.01 AS present
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def m28(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"))
    hits = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("seq_id"), "name", F.col("l_discount").alias("p_val"))
    return mt.best_hit(hits, 0.01)


@query("m29_annotate", f"""WITH {_HITS} SELECT seq_id, 'ELM' AS type, count(*) AS n FROM hits GROUP BY 1
  UNION ALL SELECT seq_id, 'HomIsland', count(*) FROM win WHERE c || c1 || c2 = 'ana' GROUP BY 1
  UNION ALL SELECT seq_id, 'ResistSite', count(*) FROM seqs, (VALUES {", ".join(str(r) for r in _RULES)}) r(rule, wild, mutant)
    WHERE regexp_matches(seq, wild) OR regexp_matches(seq, mutant) GROUP BY 1""")
def m29(spark, d):
    s = seqs(spark, d)
    full = mt.annotate(motif_hits=mt.scan_motifs(s, MOTIFS), site_calls=mt.call_sites(s, _RULES), island_hits=mt.find_islands(s, [("ana", "ana")]))
    return full.groupBy("seq_id", "type").agg(F.count("*").alias("n"))


@query("m30_rollup_calls", """SELECT source AS pat, lang AS feature, max(n_chars) AS value FROM documents GROUP BY 1, 2""")
def m30(spark, d):
    calls = table(spark, d, "documents").select(F.col("source").alias("pat"), F.col("lang").alias("feature"), F.col("n_chars").alias("value"))
    return mt.rollup_calls(calls)


@query("f5_map_symbols", f"""WITH {SEQS_SQL} SELECT seq_id, CAST(len(regexp_extract_all(translate(seq, 'aeiou', '#####'), '#')) AS INTEGER) AS n_vowels FROM seqs""")
def f5(spark, d):
    mapped = pw.map_symbols(seqs(spark, d), {v: "#" for v in "aeiou"})
    return mapped.select("seq_id", sc.match_count("seq", "#").alias("n_vowels"))


# --- scalar functions over sequences ----------------------------------------------

@query("p1_filter_by_ids", """SELECT doc_id AS seq_id, md5(lower(text)) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def p1(spark, d):
    from strandframe.operators.joins import semi
    ids = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("seq_id"))
    return semi(seqs(spark, d), ids, "seq_id").select("seq_id", F.md5("seq").alias("digest"))


@query("p2_clean_seq", """WITH c AS (SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^A-Z]', '', 'g') AS s FROM documents)
  SELECT seq_id, CASE WHEN regexp_full_match(s, '[A-Y]*') THEN md5(s) END AS digest FROM c""")
def p2(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.md5(sc.clean_seq("text", "A-Y")).alias("digest"))


@query("p4_tail_seq", f"WITH {SEQS_SQL} SELECT seq_id, right(seq, 50) AS tail FROM seqs")
def p4(spark, d):
    return seqs(spark, d).select("seq_id", sc.tail_seq("seq", 50).alias("tail"))


#: Prose turned into bases, so that codons and reading frames exist.
_DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def dna(spark, d) -> DataFrame:
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("seq_id"), F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGT" * 6 + "AC").alias("seq"))


_CODON_ROWS = ", ".join(f"('{c}', '{a}')" for c, a in sc.CODONS.items())


@query("p5_translate_codons", f"""WITH dna AS (SELECT doc_id AS seq_id, {_DNA} AS s FROM documents), codons(codon, aa) AS (VALUES {_CODON_ROWS}),
  c AS (SELECT seq_id, unnest(regexp_extract_all(s, '...')) AS codon, unnest(range(length(s) // 3)) AS i FROM dna),
  p AS (SELECT seq_id, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS p FROM c LEFT JOIN codons USING (codon) GROUP BY 1)
  SELECT d.seq_id, coalesce(split_part(p, '*', 1), '') AS protein FROM dna d LEFT JOIN p USING (seq_id)""")
def p5(spark, d):
    return dna(spark, d).select("seq_id", sc.translate_codons("seq").alias("protein"))


@query("p6_orfs", f"""WITH dna AS (SELECT doc_id AS seq_id, {_DNA} AS s FROM documents), codons(codon, aa) AS (VALUES {_CODON_ROWS}),
  c AS (SELECT seq_id, f AS frame, unnest(regexp_extract_all(substring(s, f + 1), '...')) AS codon, unnest(range((length(s) - f) // 3)) AS i FROM dna, (SELECT unnest([0, 1, 2]) AS f)),
  a AS (SELECT seq_id, frame, i, aa, min(CASE WHEN aa = '*' THEN i END) OVER (PARTITION BY seq_id, frame ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop,
    max(i) OVER (PARTITION BY seq_id, frame) + 1 AS n FROM c JOIN codons USING (codon))
  SELECT seq_id, frame, CAST(i * 3 + frame AS INTEGER) AS start, CAST(coalesce(stop, n) - i AS INTEGER) AS n_aa FROM a WHERE aa = 'M'""")
def p6(spark, d):
    return sc.orfs(dna(spark, d)).select("seq_id", "frame", "start", F.length("protein").alias("n_aa"))


_CODES = ", ".join(f"('{c}', '{b}')" for c, bases in sc.AMBIGUITY.items() for b in bases)


@query("p7_base_weights", f"""WITH w(code, base) AS (VALUES {_CODES}), k AS (SELECT code, base, 1.0 / count(*) OVER (PARTITION BY code) AS weight FROM w),
  n AS (SELECT upper(substring(p_name, 1, 1)) AS code, count(*) AS n FROM part GROUP BY 1)
  SELECT base, round(CAST(sum(n * weight) AS DOUBLE), 6) AS mass FROM n JOIN k USING (code) GROUP BY 1""")
def p7(spark, d):
    first = table(spark, d, "part").select(F.upper(F.substring("p_name", 1, 1)).alias("code"))
    return first.join(F.broadcast(sc.base_weights(spark)), "code").groupBy("base").agg(F.round(F.sum("weight"), 6).alias("mass"))


@query("p8_onehot_base", f"""WITH {SEQS_SQL} SELECT seq_id, CASE WHEN b IN ('A', 'C', 'G', 'T', '-') THEN CAST(b = 'A' AS INTEGER) END AS is_a, CASE WHEN b IN ('A', 'C', 'G', 'T', '-') THEN CAST(b = 'C' AS INTEGER) END AS is_c,
  CASE WHEN b IN ('A', 'C', 'G', 'T', '-') THEN CAST(b = 'T' AS INTEGER) END AS is_t FROM (SELECT seq_id, upper(substring(seq, 1, 1)) AS b FROM seqs)""")
def p8(spark, d):
    return seqs(spark, d).select("seq_id", sc.onehot_base(F.substring("seq", 1, 1)).alias("h")).select("seq_id", "h.is_a", "h.is_c", "h.is_t")


@query("p9_clean_term", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ', x' WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE 'x, ' || p_name || ' ' END AS term FROM part""")
def p9(spark, d):
    key, name = F.col("p_partkey"), F.col("p_name")
    raw = (F.when(key % 4 == 0, F.concat(F.lit(" ,"), name, F.lit(", x,"))).when(key % 4 == 1, F.concat(name, F.lit("~ GO")))
           .when(key % 4 == 2, F.concat(name, F.lit("; hsa04110"))).otherwise(F.concat(F.lit("x, "), name, F.lit(" ,, "))))
    return table(spark, d, "part").select("p_partkey", sc.clean_term(raw).alias("term"))


@query("p11_split_multi", """SELECT p_partkey, trim(unnest(string_split(p_name || ' /// ' || p_brand || ' ///' || p_type, '///'))) AS term FROM part""")
def p11(spark, d):
    cell = F.concat(F.col("p_name"), F.lit(" /// "), F.col("p_brand"), F.lit(" ///"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.explode(sc.split_multi(cell)).alias("term"))


@query("p15_near", """SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND abs(p_size - 20) < 5""")
def p15(spark, d):
    from strandframe.operators.features import near
    return table(spark, d, "part").filter(near(F.col("p_type"), "PROMO", F.col("p_size"), 20, 5)).select("p_partkey")


@query("p16_hash_seq", f"WITH {SEQS_SQL} SELECT seq_id, md5(seq) AS digest FROM seqs")
def p16(spark, d):
    return seqs(spark, d).select("seq_id", sc.hash_seq("seq").alias("digest"))


@query("p17_mismatch_neighbours", """WITH w AS (SELECT DISTINCT substring(p_name, 1, 3) AS seq FROM part), l AS (SELECT unnest(['a', 'e', 'r']) AS x),
  n AS (SELECT seq, seq AS neighbour FROM w UNION SELECT seq, x || seq[2:] FROM w, l UNION SELECT seq, seq[1] || x || seq[3] FROM w, l UNION SELECT seq, seq[:2] || x FROM w, l)
  SELECT seq, neighbour FROM n""")
def p17(spark, d):
    words = table(spark, d, "part").select(F.substring("p_name", 1, 3).alias("seq")).distinct()
    return sc.mismatch_neighbours(words, 1, "seq", "aer").select("seq", "neighbour").distinct()


@query("p21_mark_mismatch", f"""WITH {_WINDOWS} SELECT seq_id, start, (CASE WHEN c = 't' THEN 'T' ELSE c END) || (CASE WHEN c1 = 'h' THEN 'H' ELSE c1 END) || (CASE WHEN c2 = 'e' THEN 'E' ELSE c2 END) || (CASE WHEN c3 = 'n' THEN 'N' ELSE c3 END) AS marked
  FROM win WHERE regexp_matches(c || c1 || c2 || c3, '^th.n')""")
def p21(spark, d):
    hits = mt.scan_motifs(seqs(spark, d), [("thxn", "th.n")])
    return hits.select("seq_id", "start", sc.mark_mismatch("match", F.lit("then")).alias("marked"))


@query("p22_windows", f"""WITH {SEQS_SQL}, parts AS (SELECT seq_id, seq, unnest(range(0, greatest(length(seq), 1), 500)) AS o FROM seqs)
  SELECT seq_id, CAST(o AS INTEGER) AS "offset", md5(substring(seq, o + 1, 600)) AS digest FROM parts WHERE length(seq) > 0""")
def p22(spark, d):
    return sc.windows(seqs(spark, d), 500, 100).select("seq_id", "offset", F.md5("seq").alias("digest"))


@query("p23_strip_ns", """SELECT page_id, split_part(url, '://', 2) IS NOT NULL AS has, substring(url, strpos(url, ':') + 1) AS rest FROM pages WHERE length(url) - length(replace(url, ':', '')) = 1""")
def p23(spark, d):
    one = table(spark, d, "pages").filter(F.length("url") - F.length(F.replace(F.col("url"), F.lit(":"))) == 1)
    return one.select("page_id", F.lit(True).alias("has"), sc.strip_ns("url").alias("rest"))


@query("p24_order_by_int", """SELECT substring(p_brand, 7) AS key, count(*) AS n FROM part GROUP BY 1""")
def p24(spark, d):
    keys = table(spark, d, "part").groupBy(F.substring("p_brand", 7, 9).alias("key")).agg(F.count("*").alias("n"))
    return sc.order_by_int(keys, "key")


@query("p10_encode_labels", """SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) AS INTEGER) AS code FROM documents""")
def p10(spark, d):
    from strandframe.operators.models import encode_labels
    return encode_labels(table(spark, d, "documents").select("doc_id", "lang"), "lang")


@query("p12_standardise_names", """WITH d AS (SELECT p_partkey AS id, p_name AS text, p_type AS note FROM part),
  f AS (SELECT id, list_filter(['red', 'ring', 'PROMO', 'small'], lambda n: contains(text, n)) AS a, list_filter(['red', 'ring', 'PROMO', 'small'], lambda n: contains(text || ' ' || note, n)) AS b FROM d)
  SELECT id, CASE WHEN len(a) = 1 THEN a[1] WHEN len(b) = 1 THEN b[1] END AS gene FROM f""")
def p12(spark, d):
    from strandframe.sources.genbank import standardise_names
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("note"))
    return standardise_names(rows, {n: n for n in ("red", "ring", "PROMO", "small")}).select("id", "gene")


@query("p13_aa_to_nt", """SELECT l_suppkey, l_linenumber * 3 + s_nationkey * 100 AS start, CAST(l_quantity AS INTEGER) * 3 + s_nationkey * 100 AS "end" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def p13(spark, d):
    from strandframe.operators.features import aa_to_nt
    sites = table(spark, d, "lineitem").select("l_suppkey", F.col("l_suppkey").alias("gene"), F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("int").alias("end"))
    genes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gene"), (F.col("s_nationkey") * 100).alias("start"))
    return aa_to_nt(sites, genes).select("l_suppkey", "start", "end")


_MASK_SQL = SEQS_SQL + """, spans AS (SELECT seq_id, strpos(seq, 'tion') - 1 AS start, strpos(seq, 'tion') + 3 AS stop FROM seqs WHERE strpos(seq, 'tion') > 0)"""


def _spans(spark, d):
    from strandframe.operators.features import merge_intervals
    first = mt.scan_motifs(seqs(spark, d), [("tion", "tion")]).groupBy("seq_id").agg(F.min("start").alias("start"))
    merged = merge_intervals(first.withColumn("end", F.col("start") + 4), ["seq_id"])
    ivals = merged.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("ivals"))
    return seqs(spark, d).join(ivals, "seq_id")


@query("p19_mask_vector", f"""WITH {_MASK_SQL} SELECT seq_id, md5(repeat('0', start) || '1111' || repeat('0', length(seq) - start - 4)) AS mask FROM spans JOIN seqs USING (seq_id)""")
def p19(spark, d):
    return _spans(spark, d).select("seq_id", F.md5(sc.mask_vector(F.length("seq").cast("long"), "ivals")).alias("mask"))


@query("p20_markup", f"""WITH {_MASK_SQL} SELECT seq_id, md5(left(seq, start) || '<b>tion</b>' || substring(seq, start + 5)) AS marked FROM spans JOIN seqs USING (seq_id)""")
def p20(spark, d):
    return _spans(spark, d).select("seq_id", F.md5(sc.markup("seq", "ivals")).alias("marked"))
