"""Queries on page parsing, file round trips and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.operators.motifs import best_hit
from strandframe.plans.motifs import _HITS
from strandframe.plans.registry import query, table
from strandframe.plans.views import MOTIFS, TIMELINE_SQL, regimen
from strandframe.session import run_path
from strandframe.sources import fasta, genbank, html, sinks, tables
from strandframe.streaming import scans


@query("s6_s7_fasta_round_trip", """SELECT CAST(doc_id AS VARCHAR) AS seq_id, md5(regexp_replace(lower(text), '[\\s>]', '', 'g')) AS digest FROM documents""")
def s6(spark, d):
    path = run_path(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("seq_id"), F.regexp_replace(F.lower("text"), r"[\s>]", "").alias("seq"))
    fasta.write_fasta(docs, path)
    return fasta.read_fasta(spark, path).select("seq_id", F.md5("seq").alias("digest"))


@query("s8_parse_header", """SELECT DISTINCT user_id AS pat, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS week FROM events""")
def s8(spark, d):
    week = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    h = table(spark, d, "events").select(F.concat(F.lit("PtID "), F.col("user_id"), F.lit("|Alias x|Week "), week).alias("header"))
    return fasta.parse_header(h).select(F.col("pat").cast("long").alias("pat"), "week").distinct()


@query("s1_s3_nodes_round_trip", "SELECT DISTINCT p_name AS id FROM part")
def s1(spark, d):
    path = run_path(spark)
    sinks.write_nodes(table(spark, d, "part").select(F.col("p_name").alias("id")), path)
    return tables.read_nodes(spark, path)


@query("s2_s4_edges_round_trip", """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem) SELECT a, b FROM e UNION SELECT b, a FROM e""")
def s2(spark, d):
    path = run_path(spark)
    li = table(spark, d, "lineitem")
    sinks.write_edges(li.select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")), path)
    return tables.read_edges(spark, path)


@query("s10_read_measure", """SELECT CAST(user_id AS BIGINT) AS pat, CAST(extract('day' FROM ts) AS DOUBLE) AS week, 'view' AS kind, value AS val, CASE WHEN value > 100 THEN 1 WHEN value < 1 THEN -1 ELSE 0 END AS censor FROM events WHERE event_type = 'view'""")
def s10(spark, d):
    path = run_path(spark)
    sign = F.when(F.col("value") > 100, ">").when(F.col("value") < 1, "<").otherwise("=")
    table(spark, d, "events").filter("event_type = 'view'").select(
        F.col("user_id").alias("PtID"), F.dayofmonth("ts").alias("RNADate"), F.col("value").alias("VLoad"), sign.alias("VLoadMatch")).write.csv(path, sep="\t", header=True)
    return tables.read_measure(spark, path, "view")


@query("s11_read_regimen", """SELECT o_custkey AS pat, CAST(min(l_linenumber) AS DOUBLE) AS start, CAST(max(l_linenumber) AS DOUBLE) AS stop, l_returnflag AS drug FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_returnflag""")
def s11(spark, d):
    path = run_path(spark)
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = li.groupBy("o_custkey", "l_returnflag").agg(F.min("l_linenumber").alias("StartDate"), F.max("l_linenumber").alias("StopDate"))
    flags = [(F.col("l_returnflag") == x).cast("int").alias(x) for x in ("A", "N", "R")]
    per.select(F.col("o_custkey").alias("PtID"), F.lit("x").alias("Alias"), F.lit(0).alias("ExactDateUnknown"), F.lit(0).alias("DrugOrderUnknown"),
               "StartDate", "StopDate", *flags).write.csv(path, sep="\t", header=True)
    return tables.read_regimen(spark, path).withColumn("pat", F.col("pat").cast("long"))


@query("s14_read_gmt", "SELECT DISTINCT p_type AS set_name, p_name AS gene FROM part")
def s14(spark, d):
    path = run_path(spark)
    p = table(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_name").alias("g"))
    p.select(F.concat_ws("\t", "p_type", F.lit("na"), F.array_join("g", "\t")).alias("value")).write.text(path)
    return tables.read_gmt(spark, path).select("set_name", "gene")


@query("s15_read_chart", """SELECT p_type AS category, p_brand AS term, CAST(count(DISTINCT p_name) AS INTEGER) AS "count", CAST(min(p_size) AS DOUBLE) AS pvalue, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS genes FROM part GROUP BY 1, 2""")
def s15(spark, d):
    path = run_path(spark)
    p = table(spark, d, "part").groupBy(F.col("p_type").alias("Category"), F.col("p_brand").alias("Term")).agg(
        F.countDistinct("p_name").alias("Count"), F.min("p_size").alias("PValue"), F.array_join(F.sort_array(F.collect_set("p_name")), ", ").alias("Genes"))
    p.write.csv(path, sep="\t", header=True)
    return tables.read_chart(spark, path).withColumn("genes", F.array_join("genes", ","))


@query("s16_read_annotation_table", """SELECT 'p_type' AS category, 'T1:' || CASE WHEN p_type LIKE '%O' THEN left(p_type, length(p_type) - 4) ELSE p_type END AS term, CAST(p_partkey AS VARCHAR) AS gene FROM part
  UNION ALL SELECT 'p_name', 'B' || p_size || ':' || p_name, CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'p_name', 'C2:' || p_brand, CAST(p_partkey AS VARCHAR) FROM part""")
def s16(spark, d):
    path = run_path(spark)
    cells = F.concat(F.lit("B"), "p_size", F.lit(":"), "p_name", F.lit(","))
    two = F.concat(F.lit("C2:"), "p_brand", F.lit(" ,"))
    p = table(spark, d, "part")
    p.select("p_partkey", F.concat(F.lit("x T1:"), "p_type", F.lit(",")).alias("p_type"), cells.alias("p_name")).write.csv(f"{path}/a", sep="\t", header=True)
    p.select("p_partkey", two.alias("p_name")).write.csv(f"{path}/b", sep="\t", header=True)
    return tables.read_annotation_table(spark, f"{path}/a", "p_partkey", ["p_type", "p_name"]).union(
        tables.read_annotation_table(spark, f"{path}/b", "p_partkey", ["p_name"]))


@query("s17_read_gene2term", """SELECT CAST(l_partkey AS VARCHAR) AS gene, l_returnflag AS term, l_linestatus AS category FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)""")
def s17(spark, d):
    path = run_path(spark)
    n = F.lit("x")
    table(spark, d, "lineitem").select(n.alias("tax"), F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("term"), n.alias("evidence"), n.alias("qualifier"),
                                       n.alias("name"), n.alias("pubmed"), F.col("l_linestatus").alias("category")).write.csv(path, sep="\t", header=True)
    genes = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").cast("string").alias("gene"))
    return tables.read_gene2term(spark, path, genes).select("gene", "term", "category")


@query("s18_read_chip_annotation", """SELECT CAST(p_partkey AS VARCHAR) AS probe, p_brand AS gene, 'Pathway' AS category, p_type AS term FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, 'Pathway', p_name FROM part""")
def s18(spark, d):
    path = run_path(spark)
    cells = F.concat(F.lit("0001 // "), F.col("p_type"), F.lit(" // x /// 0002 // "), F.col("p_name"), F.lit(" // y"))
    table(spark, d, "part").select(F.col("p_partkey").alias("Probe Set ID"), F.col("p_brand").alias("Gene Symbol"), cells.alias("Pathway")).write.csv(path, header=True)
    return tables.read_chip_annotation(spark, path, columns=("Probe Set ID", "Gene Symbol", ["Pathway"]))


@query("s9_read_annotations", """SELECT CAST(l_suppkey AS VARCHAR) AS gene, l_linenumber - 1 AS start, CAST(l_quantity AS INTEGER) AS "end", l_returnflag AS domain FROM lineitem WHERE l_linestatus = 'O'""")
def s9(spark, d):
    path = run_path(spark)
    table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"), "l_returnflag", F.lit("seq").alias("s"), "l_linestatus").write.csv(path, sep="\t")
    return tables.read_annotations(spark, path, ["O"]).select("gene", "start", "end", "domain")


@query("s20_read_expression", """SELECT 'all' AS dataset, 'g' || (g - 1) AS probe, CAST(vec_id AS VARCHAR) AS sample, round(CAST(embedding[g] AS DOUBLE), 6) AS value, label AS cls FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS g FROM embeddings)""")
def s20(spark, d):
    path = run_path(spark)
    # a fixed width keeps one sample name from being the prefix of another
    e = table(spark, d, "embeddings").select(F.concat(F.lit("S"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("sample"), "label", "embedding").filter(
        "sample IS NOT NULL AND size(embedding) > 0")
    # a probe is a line of text, not a row with a column per sample
    one = e.groupBy("sample").agg(F.first("embedding").alias("v"))
    widest = one.agg(F.max(F.size("v"))).first()[0] or 1
    cells = one.select("sample", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(widest - 1)), lambda g: F.get("v", g).cast("double"))).alias("g", "v"))
    lines = cells.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("sample", F.coalesce(F.col("v").cast("string"), F.lit("")).alias("v")))).alias("c"))
    lines = lines.select((F.col("g") % 8).alias("part"), (F.col("g") + 1).alias("at"), F.concat_ws("\t", F.concat(F.lit("g"), "g"), F.col("c.v")).alias("value"))
    head = one.agg(F.concat_ws("\t", F.lit("probe"), F.array_sort(F.collect_list("sample"))).alias("value"))
    heads = head.select(F.explode(F.sequence(F.lit(0), F.lit(min(widest, 8) - 1))).alias("part"), F.lit(0).alias("at"), "value")  # every file begins with it
    lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(f"{path}/m")
    e.select(F.concat_ws(" ", "sample", F.concat(F.lit("D"), "label")).alias("value")).distinct().write.text(f"{path}/c")
    out = tables.read_expression(spark, f"{path}/m", f"{path}/c", "all")
    return out.select("dataset", "probe", F.expr("substring(sample, 2)").cast("int").cast("string").alias("sample"), F.round("value", 6).alias("value"), "cls")


@query("s21_extract_motifs", r"""SELECT page_id AS name, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) <> '' AS has_title FROM pages WHERE regexp_extract(html, '(?s)<td[^>]*>\s*(.*?)\s*</td>', 1) <> ''
  AND trim(replace(regexp_replace(regexp_extract(html, '(?s)<td[^>]*>\s*(.*?)\s*</td>', 1), '<[^>]*>', '', 'g'), '&nbsp;', '')) <> ''""")
def s21(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    found = html.extract_motifs(pages, "<title").select("name")
    return found.join(pages.select(F.col("page_id").alias("name"), (F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1) != "").alias("has_title")), "name")


@query("s22_extract_hits", r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<h1>[^<]*')) AS block FROM pages) SELECT page_id, count(*) AS n FROM b GROUP BY 1""")
def s22(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat_ws("", F.regexp_extract_all("html", F.lit(r"(<h1>[^<]*)"), F.lit(1))).alias("heads"))
    marked = pages.select("page_id", F.regexp_replace("heads", "<h1>[^<]*", "<b>HIT_x</b> 11-15").alias("html"))
    return html.extract_hits(marked).filter("start = 10 AND end = 15 AND name = 'HIT_x'").groupBy("page_id").agg(F.count("*").alias("n"))


@query("s23_extract_tables", r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<t[dh][ >]')) AS BIGINT) AS n_cells, CAST(len(regexp_extract_all(html, '<table')) AS BIGINT) AS n_tables FROM pages WHERE regexp_matches(html, '<t[dh][ >]')""")
def s23(spark, d):
    cells = html.extract_tables(table(spark, d, "pages"))
    return cells.groupBy("page_id").agg(F.count("*").alias("n_cells"), F.countDistinct("table").alias("n_tables"))


@query("s26_regroup_hits", """SELECT CAST(l_suppkey AS VARCHAR) AS seq_id, l_returnflag AS name, count(*) AS n_hits, CAST(sum(start) AS BIGINT) AS sum_start FROM
  (SELECT DISTINCT l_suppkey, l_returnflag, l_linenumber + l_orderkey % 3 * 500 AS start, l_discount FROM lineitem) GROUP BY 1, 2""")
def s26(spark, d):
    li = table(spark, d, "lineitem")
    piece = F.col("l_orderkey") % 3 * 500
    name = F.when(piece == 0, F.col("l_suppkey").cast("string")).otherwise(F.concat_ws("|", F.col("l_suppkey").cast("string"), piece.cast("string")))
    hits = tables.regroup_hits(li.select(name.alias("seq_name"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("start"), F.col("l_discount").alias("p_val")))
    return hits.select("seq_id", "name", F.size("hits").cast("long").alias("n_hits"),
                       F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["start"]).alias("sum_start"))


@query("s29_read_positions", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS chrom, l_partkey AS pos FROM lineitem")
def s29(spark, d):
    path = run_path(spark)
    table(spark, d, "lineitem").select("l_suppkey", "l_partkey").write.csv(path, sep="\t")
    return tables.read_positions(spark, path)


@query("s30_convert", "SELECT CAST(p_partkey AS VARCHAR) AS a, p_name AS b FROM part")
def s30(spark, d):
    path = run_path(spark)
    table(spark, d, "part").select("p_partkey", "p_name").write.csv(f"{path}/tsv", sep="\t")
    tables.convert(spark, f"{path}/tsv", f"{path}/csv")
    return spark.read.csv(f"{path}/csv", schema="a string, b string")


@query("s31_read_id_map", "SELECT DISTINCT key, CAST(p_partkey AS VARCHAR) AS id FROM (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS key FROM part)")
def s31(spark, d):
    path = run_path(spark)
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type").write.csv(path, sep="\t", header=True)
    return tables.read_id_map(spark, path, ["p_name", "p_brand", "p_type"], "p_partkey")


@query("s32_read_flat_records", """SELECT 'ko:K' || p_partkey AS entry, split_part(p_name, ' ', 1) AS name, CASE WHEN p_size % 2 = 0 THEN p_size || '.1.-.-' ELSE '' END AS ec FROM part""")
def s32(spark, d):
    path = run_path(spark)
    links = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("DBLINKS     EC: "), "p_size", F.lit(".1.-.- 9.9.9.9\n"))).otherwise(F.lit(""))
    text = F.concat(F.lit("ENTRY       K"), F.col("p_partkey"), F.lit("  KO\nNAME        "), F.col("p_name"), F.lit("\nDEFINITION  thing [EC:7.7.7.7]\n"), links, F.lit("///"))
    table(spark, d, "part").select(text.alias("value")).write.text(path)
    return genbank.read_flat_records(spark, path)


def _write_named(df: DataFrame, folder: str, name: str) -> None:
    """One delimited file of a given name, as a study's folder has them."""
    spark, part = df.sparkSession, run_path(df.sparkSession)
    df.coalesce(1).write.csv(part, sep="\t", header=True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(folder))
    fs.rename(fs.globStatus(hadoop(f"{part}/part-*"))[0].getPath(), hadoop(f"{folder}/{name}"))


@query("s12_read_study_dir", """SELECT CAST(c_custkey AS BIGINT) AS pat, 'cd4' AS part, 'ST' || c_nationkey % 3 AS study, CAST(c_nationkey AS DOUBLE) AS val FROM customer
  UNION ALL SELECT CAST(c_custkey AS BIGINT), 'rna', 'ST' || c_nationkey % 3, CAST(c_nationkey AS DOUBLE) + 1 FROM customer""")
def s12(spark, d):
    path = run_path(spark)
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("study"), F.col("c_nationkey").cast("double").alias("v"))
    for k in range(3):
        for role, more in (("CD4", 0), ("RNA", 1)):
            rows = c.filter(F.col("study") == k).select(F.col("c_custkey").alias("PtID"), F.lit(0).alias("Date"), (F.col("v") + more).alias("Value"))
            _write_named(rows, path, f"ST{k}_{role}.txt")
    found = tables.read_study_dir(spark, path)
    parts = [found[r].select(F.col("pat").cast("long").alias("pat"), F.lit(r).alias("part"), "study", "val") for r in ("cd4", "rna")]
    return parts[0].union(parts[1])


@query("s13_read_genbank", """SELECT p_brand AS gene, p_name AS product, p_partkey - 1 AS start, p_partkey + 29 AS "end", 'MK' || p_size % 7 AS aa FROM part""")
def s13(spark, d):
    path = run_path(spark)
    pad = F.lit(" " * 21)
    text = F.concat(
        F.lit("     CDS             join("), "p_partkey", F.lit(".."), F.col("p_partkey") + 29, F.lit(",900..905)\n"),
        pad, F.lit('/gene="'), "p_brand", F.lit('"\n'), pad, F.lit('/product="'), "p_name", F.lit('"\n'), pad, F.lit('/translation="MK\n'), pad, F.col("p_size") % 7,
        F.lit('"\n     CDS             1..3\n'), pad, F.lit('/gene="a-b"'))
    table(spark, d, "part").select(text.alias("value")).write.text(path)
    found = genbank.read_genbank(spark, path)
    return found.select("gene", "product", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "aa")


@query("s19_read_chip_annotation_web", """SELECT CAST(p_partkey AS VARCHAR) AS probe, p_brand AS gene, 'Pathway' AS category, p_type AS term FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, 'GO', p_name FROM part""")
def s19(spark, d):
    path = run_path(spark)
    table(spark, d, "part").select(F.col("p_name").alias("GO"), F.col("p_brand").alias("Symbol"), F.col("p_type").alias("Pathway"), F.col("p_partkey").alias("Probe")).write.csv(
        path, header=True, quoteAll=True)
    return tables.read_chip_annotation(spark, path, "web")


@query("s24_read_site_rules", """SELECT p_brand || ' ' || p_size AS rule, p_type AS gene, '[' || p_partkey || '][' || p_brand || '][' || p_name || ']' AS wild,
  '[' || p_partkey || '][' || p_size * 2 || '][' || p_name || ']' AS mutant FROM part""")
def s24(spark, d):
    path = run_path(spark)
    table(spark, d, "part").select(F.col("p_partkey").alias("prec"), F.col("p_name").alias("trail"), F.col("p_brand").alias("cons"), F.col("p_size").alias("pos"),
                                   (F.col("p_size") * 2).alias("mut"), F.col("p_type").alias("gene")).write.csv(path, sep="\t", header=True)
    return tables.read_site_rules(spark, path)


@query("s25_read_mirna", "SELECT p_partkey || '-5p' AS name, upper(replace(p_name, '-', '')) AS seq FROM part")
def s25(spark, d):
    path = run_path(spark)
    x = F.lit("x")
    table(spark, d, "part").select(x.alias("#a"), x.alias("b"), x.alias("c"), F.concat("p_partkey", F.lit("-5p")).alias("d"), x.alias("e"),
                                   F.regexp_replace("p_name", "^(..)", "$1-").alias("f")).write.csv(path, sep="\t", header=True)
    return tables.read_mirna(spark, path)


@query("s27_bins_round_trip", "SELECT p_brand AS motif, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS edges FROM part GROUP BY 1")
def s27(spark, d):
    path = run_path(spark)
    tables.write_bins(table(spark, d, "part").groupBy(F.col("p_brand").alias("motif")).agg(F.collect_set("p_size").alias("edges")), path)
    return tables.read_bins(spark, path).select("motif", F.array_join(F.sort_array(F.col("edges").cast("array<string>")), ",").alias("edges"))


@query("s28_read_sites_aa", """SELECT lower(n_name) AS gene, p_size * 3 + n_nationkey * 100 AS start, (p_size + 2) * 3 + n_nationkey * 100 AS "end", p_name AS name, p_type AS match
  FROM part JOIN nation ON n_nationkey = p_partkey % 30""")
def s28(spark, d):
    path = run_path(spark)
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("gene"))
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey") % 30).join(n, "k", "left")
    p.select(F.upper(F.coalesce("gene", F.lit("unknown"))).alias("gene"), "p_size", F.col("p_size") + 2, "p_name", "p_type", F.lit("[AB]")).write.csv(path, sep="\t")
    return tables.read_sites(spark, path, "AA", n.select("gene", (F.col("k") * 100).cast("int").alias("start")))


@query("s28_read_sites_nt", """SELECT CAST(p_partkey AS VARCHAR) AS gene, p_size AS start, CAST(p_size + length(p_type) AS INTEGER) AS "end", p_name AS name, p_type AS match FROM part""")
def s28b(spark, d):
    path = run_path(spark)
    table(spark, d, "part").select("p_partkey", "p_size", F.lit("(+)"), F.lit(0.9).alias("c"), F.lit(0.8).alias("m"), "p_type", "p_name").write.csv(path, sep="\t")
    return tables.read_sites(spark, path, "NT")


@query("s37_read_ontology", "SELECT n_nationkey AS id, n_name AS name, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey")
def s37(spark, d):
    path = run_path(spark)
    table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey").write.parquet(f"{path}/term")
    table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("parent")).write.parquet(f"{path}/term2term")
    found = tables.read_ontology(spark, path, tables=("term", "term2term"))
    return found["term"].join(found["term2term"], "n_regionkey").select("id", "name", "parent")


@query("s34_feature_matrix", """SELECT c_custkey AS pat, c_mktsegment AS regimen, CASE WHEN 10 BETWEEN 0 AND c_nationkey * 10 THEN CAST(bool_or(coalesce(o_orderstatus = 'F', false)) AS INTEGER) END AS "F@10",
  CASE WHEN 100 BETWEEN 0 AND c_nationkey * 10 THEN CAST(bool_or(coalesce(o_orderstatus = 'O', false)) AS INTEGER) END AS "O@100" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_nationkey""")
def s34(spark, d):
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("pat"), F.when(F.col("o_orderstatus") == "F", "F@10").when(F.col("o_orderstatus") == "O", "O@100").alias("feature")).filter("feature IS NOT NULL")
    patients = table(spark, d, "customer").select(F.col("c_custkey").alias("pat"), F.array("c_mktsegment").alias("drugs"), F.lit(0).alias("lo"), (F.col("c_nationkey") * 10).alias("hi"))
    return sinks.feature_matrix(found, patients, ["F@10", "O@100"])


@query("s35_flatten_for_export", """SELECT CAST(c_custkey AS VARCHAR) AS pat, coalesce(string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus), ' ') AS states FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def s35(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pat")).agg(F.sort_array(F.collect_set("o_orderstatus")).alias("states"))
    return sinks.flatten_for_export(table(spark, d, "customer").select(F.col("c_custkey").alias("pat")).join(o, "pat", "left"))


@query("s36_confusion_matrix", """WITH c AS (SELECT o_orderstatus AS cls, o_orderpriority AS p, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 2) AS s FROM orders GROUP BY 1, 2)
  SELECT cls, coalesce(max(CASE WHEN p = '1-URGENT' THEN s END), 0) AS "1-URGENT", coalesce(max(CASE WHEN p = '5-LOW' THEN s END), 0) AS "5-LOW" FROM c GROUP BY 1""")
def s36(spark, d):
    from strandframe.operators.models import confusion
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("cls"), F.col("o_orderpriority").alias("predicted"))
    return sinks.confusion_matrix(confusion(o), ["1-URGENT", "5-LOW"])


# --- streams ---------------------------------------------------------------------

def _stream(spark, d, name: str) -> DataFrame:
    """A table as a stream of its files. It may be one file or a folder of parts; the last letter is a pattern, as only one makes Spark take both."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query("t1_stream_scan", f"WITH {_HITS} SELECT motif, count(*) AS n_hits, CAST(sum(start) AS BIGINT) AS sum_start FROM hits GROUP BY 1")
def t1(spark, d):
    arriving = _stream(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.lower("text").alias("seq"))
    hits = scans.run_to_table(scans.stream_scan(arriving, MOTIFS), run_path(spark))
    return hits.groupBy("motif").agg(F.count("*").alias("n_hits"), F.sum("start").alias("sum_start"))


@query("t2_stream_dedupe", "SELECT DISTINCT md5(text) AS digest FROM conversations")
def t2(spark, d):
    turns = _stream(spark, d, "conversations").select(F.col("text").alias("seq"), F.current_timestamp().alias("arrived"))
    return scans.run_to_table(scans.stream_dedupe(turns), run_path(spark)).select("digest")


@query("t3_stream_responder", "WITH " + TIMELINE_SQL + """, tl AS (SELECT pat, week, avg(val) AS val FROM timeline WHERE kind = 'view' GROUP BY 1, 2), s AS (SELECT pat, val - lag(val) OVER (PARTITION BY pat ORDER BY week) AS x FROM tl)
  SELECT pat, CAST(count(*) AS INTEGER) AS n_weeks, CAST(count(CASE WHEN x <= 0 THEN 1 END) AS INTEGER) AS n_steps, count(CASE WHEN x <= 0 THEN 1 END) > 3 AS responder FROM s GROUP BY 1""")
def t3(spark, d):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", scans.STATE_STORE)
    try:
        ev = _stream(spark, d, "events").filter("event_type = 'view'").select(
            F.col("user_id").alias("pat"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("week"), F.col("value").alias("val"))
        out = scans.run_to_table(scans.stream_responder(ev), run_path(spark), "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.groupBy("pat").agg(F.max_by(F.struct("n_weeks", "n_steps", "responder"), "batch").alias("r")).select("pat", "r.*")
