"""Queries on lists, networks, ontologies, joins and grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.operators import aggregates as agg, joins, network, ontology, sets
from strandframe.plans.registry import query, table
from strandframe.plans.views import (
    CLOSURE_SQL, DAG_SQL, EDGES_SQL, EXPR_SQL, LISTS_SQL, REGIMEN_SQL, TIMELINE_SQL,
    dag, edges, expr, lists, regimen, timeline,
)
from strandframe.session import spread


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes) + " "


# --- sets -----------------------------------------------------------------

def _nation_lists(spark, d):
    """Parts sold by suppliers of each nation: three lists."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    pairs = lists(spark, d).join(s, F.col("set_id") == F.col("s_suppkey")).select("s_nationkey", "item")
    region = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    pairs = pairs.join(region, "s_nationkey").select("n_regionkey", "item").distinct()
    return [pairs.filter(F.col("n_regionkey") == r).select("item") for r in (0, 1, 2)]


_REGION_ITEMS = LISTS_SQL + """, region_items AS (SELECT DISTINCT n_regionkey AS r, item FROM lists
  JOIN supplier ON set_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


@query("o7_intersect_all", _with(_REGION_ITEMS) + """SELECT item FROM region_items WHERE r = 0
  INTERSECT SELECT item FROM region_items WHERE r = 1 INTERSECT SELECT item FROM region_items WHERE r = 2""")
def o7(spark, d):
    return sets.intersect_all(_nation_lists(spark, d))


@query("o8_union_all", _with(_REGION_ITEMS) + "SELECT DISTINCT item FROM region_items WHERE r IN (0, 1, 2)")
def o8(spark, d):
    return sets.union_distinct(_nation_lists(spark, d))


@query("o9_missing", _with(_REGION_ITEMS) + """SELECT item FROM region_items WHERE r = 0
  EXCEPT SELECT item FROM region_items WHERE r = 1""")
def o9(spark, d):
    a, b, _ = _nation_lists(spark, d)
    return sets.missing(a, b)


@query("o10_slim", """SELECT p_partkey AS term, p_type AS category, p_name AS name FROM part
  WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
    AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def o10(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("term"), "l_returnflag")
    desc = table(spark, d, "part").select(F.col("p_partkey").alias("term"), F.col("p_type").alias("category"), F.col("p_name").alias("name"))
    return sets.slim(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), desc)


@query("o11_in_list", """SELECT DISTINCT l_suppkey AS id FROM lineitem
  WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def o11(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"))
    wanted = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"))
    return sets.in_list(ids, wanted)


_GROUPS_SQL = "groups AS (SELECT s_nationkey AS group_id, s_suppkey AS set_id FROM supplier)"


@query("o12_multi_intersect", _with(LISTS_SQL, _GROUPS_SQL) + """, need AS (SELECT group_id, count(*) AS c FROM groups GROUP BY 1)
  SELECT group_id, item FROM lists JOIN groups USING (set_id) GROUP BY 1, 2
  HAVING count(*) = (SELECT c FROM need WHERE need.group_id = groups.group_id)""")
def o12(spark, d):
    groups = table(spark, d, "supplier").select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("set_id"))
    return sets.multi_intersect(lists(spark, d), groups)


@query("o1_order_timeline", _with(TIMELINE_SQL) + "SELECT * FROM timeline")
def o1(spark, d):
    return sets.order_timeline(timeline(spark, d))


def _chart(spark, d):
    """Enrichment chart: brands by type with a score from the mean discount as p-value."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_discount")
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("term")).agg(
        F.count("*").alias("count"), F.round(F.sqrt(F.avg("l_discount")) / 5, 9).alias("pvalue"))


_CHART_SQL = """chart AS (SELECT p_type AS category, p_brand AS term, count(*) AS "count", round(sqrt(avg(l_discount)) / 5, 9) AS pvalue
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@query("o2_top_terms", _with(_CHART_SQL) + """SELECT category, term, "count", pvalue, CAST(rank AS INTEGER) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY category ORDER BY "count" DESC, term) AS rank FROM chart WHERE pvalue <= 0.05) WHERE rank <= 3""")
def o2(spark, d):
    return sets.top_terms(_chart(spark, d), 3)


@query("o3_top_features", """SELECT p_partkey AS feature, sum(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1 ORDER BY score DESC, feature LIMIT 25""")
def o3(spark, d):
    scores = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("score"))
    return sets.top_features(scores, 25)


@query("o4_sort_chart", _with(_CHART_SQL) + "SELECT * FROM chart")
def o4(spark, d):
    return sets.sort_chart(_chart(spark, d))


@query("o5_order_by_class_size", """SELECT vec_id AS sample, label AS cls, count(*) OVER (PARTITION BY label) AS class_size FROM embeddings""")
def o5(spark, d):
    return sets.order_by_class_size(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("cls")))


@query("o6_first_match", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#7' ORDER BY p_partkey LIMIT 1")
def o6(spark, d):
    return sets.first_match(table(spark, d, "part"), F.col("p_brand") == "Brand#7", "p_partkey").select("p_partkey", "p_name")


# --- network ----------------------------------------------------------------

@query("a5_degree", _with(EDGES_SQL) + "SELECT a AS id, count(DISTINCT b) AS degree FROM edges GROUP BY 1")
def a5(spark, d):
    return network.degree(edges(spark, d))


@query("a6_avg_degree", _with(EDGES_SQL) + """SELECT round(avg(degree), 6) AS avg_degree FROM
  (SELECT a AS id, count(DISTINCT b) AS degree FROM edges GROUP BY 1) WHERE id LIKE 's%'""")
def a6(spark, d):
    ids = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return network.avg_degree(ids, edges(spark, d)).select(F.round("avg_degree", 6).alias("avg_degree"))


@query("a7_degree_hist", _with(EDGES_SQL) + """SELECT degree, count(*) AS n_nodes FROM
  (SELECT a AS id, count(DISTINCT b) AS degree FROM edges GROUP BY 1) WHERE id LIKE 'p%' GROUP BY 1""")
def a7(spark, d):
    ids = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return network.degree_hist(ids, edges(spark, d))


@query("s2_symmetric_edges", _with(EDGES_SQL) + "SELECT a, b FROM edges")
def s2(spark, d):
    return network.symmetric(edges(spark, d))


@query("s4_canonical_edges", _with(EDGES_SQL) + "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM edges")
def s4(spark, d):
    return network.canonical(edges(spark, d))


@query("s5_nodes_of", _with(EDGES_SQL) + "SELECT a AS id FROM edges UNION SELECT b FROM edges")
def s5(spark, d):
    return network.nodes_of(edges(spark, d))


@query("j9_neighbours", _with(EDGES_SQL) + """SELECT DISTINCT b AS id FROM edges
  WHERE a IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0) AND a <> b""")
def j9(spark, d):
    seed = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return joins.neighbours(seed, edges(spark, d))


@query("g9_consensus", _with("""weight AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, sum(l_quantity) AS similarity FROM lineitem GROUP BY 1, 2),
  und AS (SELECT a, b FROM weight WHERE similarity > 95 UNION SELECT b, a FROM weight WHERE similarity > 95),
  reach AS (SELECT a AS id, a AS other FROM und UNION SELECT r.id, u.b FROM reach r JOIN und u ON u.a = r.other)""", recursive=True)
  + "SELECT id, min(other) AS component FROM reach GROUP BY 1")
def g9(spark, d):
    sim = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("similarity")).select(
        F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), "similarity")
    return network.consensus(sim, 95)


# --- ontology ----------------------------------------------------------------

@query("g1_relations", _with(DAG_SQL) + "SELECT DISTINCT parent, child FROM dag")
def g1(spark, d):
    return ontology.relations(dag(spark, d))[1]


@query("g2_closure", _with(CLOSURE_SQL, recursive=True) + "SELECT DISTINCT ancestor, descendant, distance FROM paths")
def g2(spark, d):
    return ontology.closure(dag(spark, d))


@query("g2_expand_term", _with(CLOSURE_SQL, recursive=True) + """SELECT descendant AS term, ancestor AS related FROM paths WHERE descendant LIKE 'n%'
  UNION SELECT ancestor, descendant FROM paths WHERE distance <> 0 AND ancestor LIKE 'n%'""")
def g2b(spark, d):
    terms = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("term"))
    return ontology.expand_term(ontology.closure(dag(spark, d)), terms)


@query("g3_levels", _with(CLOSURE_SQL, recursive=True) + """SELECT descendant AS term, max(distance) AS max_level, min(distance) AS min_level,
  count(DISTINCT distance) AS n_distances FROM paths WHERE ancestor = 'root' GROUP BY 1""")
def g3(spark, d):
    lv = ontology.levels(ontology.closure(dag(spark, d)), "root")
    return lv.select("term", "max_level", "min_level", F.size("distances").cast("long").alias("n_distances"))


def _annots(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("term"), F.col("o_orderpriority").alias("member"))


_ANNOT_SQL = "annots AS (SELECT DISTINCT 'c' || o_custkey AS term, o_orderpriority AS member FROM orders)"


@query("g4_propagate", _with(CLOSURE_SQL, _ANNOT_SQL, recursive=True) + """SELECT DISTINCT ancestor AS term, member FROM annots
  JOIN paths ON descendant = term""")
def g4(spark, d):
    return ontology.propagate(_annots(spark, d), ontology.closure(dag(spark, d)))


@query("g5_informative", _with(CLOSURE_SQL, """members AS (SELECT DISTINCT ancestor AS term, descendant AS member FROM paths WHERE descendant LIKE 'c%')""",
  """big AS (SELECT term, count(*) AS n_members FROM members GROUP BY 1 HAVING count(*) >= 40)""", recursive=True)
  + "SELECT term, n_members FROM big WHERE term NOT IN (SELECT parent FROM dag WHERE child IN (SELECT term FROM big))")
def g5(spark, d):
    graph = dag(spark, d)
    base = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("term")).withColumn("member", F.col("term"))
    return ontology.informative(ontology.propagate(base, ontology.closure(graph)), graph, 40)


def _term_dim(spark, d):
    g = dag(spark, d)
    t = g.select(F.col("child").alias("term")).union(g.select("parent")).distinct()
    return t.withColumn("category", F.substring("term", 1, 1))


@query("g6_annotate_terms", _with(CLOSURE_SQL, _ANNOT_SQL, recursive=True) + """SELECT DISTINCT member, p.ancestor AS term, l.max_level AS level,
  substring(p.ancestor, 1, 1) AS category FROM annots JOIN paths p ON p.descendant = annots.term
  JOIN (SELECT descendant, max(distance) AS max_level FROM paths WHERE ancestor = 'root' GROUP BY 1) l ON l.descendant = p.ancestor""")
def g6(spark, d):
    paths = ontology.closure(dag(spark, d))
    return ontology.annotate_terms(_annots(spark, d), paths, ontology.levels(paths, "root"), _term_dim(spark, d))


@query("p14_filter_levels", _with(CLOSURE_SQL, _ANNOT_SQL, recursive=True) + """SELECT DISTINCT member, p.ancestor AS term, l.max_level AS level,
  substring(p.ancestor, 1, 1) AS category FROM annots JOIN paths p ON p.descendant = annots.term
  JOIN (SELECT descendant, max(distance) AS max_level FROM paths WHERE ancestor = 'root' GROUP BY 1) l ON l.descendant = p.ancestor
  WHERE l.max_level IN (1, 2) AND substring(p.ancestor, 1, 1) IN ('r', 'n')""")
def p14(spark, d):
    paths = ontology.closure(dag(spark, d))
    full = ontology.annotate_terms(_annots(spark, d), paths, ontology.levels(paths, "root"), _term_dim(spark, d))
    return ontology.filter_levels(full, [1, 2], ["r", "n"])


@query("g7_terms_of", """SELECT o_orderpriority AS member, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS terms FROM orders GROUP BY 1""")
def g7(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("member"), F.col("o_orderstatus").alias("term"))
    return ontology.terms_of(o).select("member", F.concat_ws(",", "terms").alias("terms"))


@query("g7_term_dim", """SELECT DISTINCT p_name AS name, p_brand AS term, p_type AS category, p_size AS term_id FROM part""")
def g7b(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_size").alias("term_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return ontology.term_dim(p)


@query("g8_pathway_edges", """SELECT DISTINCT 's' || l_suppkey AS a, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey""")
def g8(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    typed = j.select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.col("p_brand").alias("b"))
    members = j.select(F.col("p_type").alias("pathway"), F.col("p_brand").alias("gene"), F.lit(None).cast("string").alias("complex"))
    return ontology.pathway_graph(typed, members)["edges"]


@query("s33_pathway_members", """SELECT DISTINCT p_type AS pathway, p_brand AS gene FROM part""")
def s33(spark, d):
    m = table(spark, d, "part").select(F.col("p_type").alias("pathway"), F.col("p_brand").alias("gene"), F.lit(None).cast("string").alias("complex"))
    return ontology.pathway_graph(m.select(F.col("gene").alias("a"), F.col("pathway").alias("b")), m)["pathway_genes"]


# --- joins ----------------------------------------------------------------

def _first(spark, d, kind):
    return timeline(spark, d).filter(F.col("kind") == kind).groupBy("pat").agg(F.max("val").alias(kind))


@query("j1_build_cohort", _with(TIMELINE_SQL) + """SELECT c.pat, c.click, v.view, r.purchase, round(s.signup, 6) AS signup FROM
  (SELECT pat, max(val) AS click FROM timeline WHERE kind = 'click' GROUP BY 1) c
  JOIN (SELECT pat, max(val) AS view FROM timeline WHERE kind = 'view' GROUP BY 1) v USING (pat)
  JOIN (SELECT pat, max(val) AS purchase FROM timeline WHERE kind = 'purchase' GROUP BY 1) r USING (pat)
  LEFT JOIN (SELECT pat, max(val) AS signup FROM timeline WHERE kind = 'signup' GROUP BY 1) s USING (pat)""")
def j1(spark, d):
    return joins.build_cohort(_first(spark, d, "click"), _first(spark, d, "view"), _first(spark, d, "purchase"), _first(spark, d, "signup"))


@query("j2_assemble", _with(TIMELINE_SQL) + """SELECT c.pat, c.click, v.view, r.error FROM
  (SELECT pat, max(val) AS click FROM timeline WHERE kind = 'click' GROUP BY 1) c
  JOIN (SELECT pat, max(val) AS view FROM timeline WHERE kind = 'view' GROUP BY 1) v USING (pat)
  JOIN (SELECT pat, max(val) AS error FROM timeline WHERE kind = 'error' GROUP BY 1) r USING (pat)""")
def j2(spark, d):
    return joins.assemble([_first(spark, d, k) for k in ("click", "view", "error")])


@query("j3_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j3(spark, d):
    return joins.semi(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("j4_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4(spark, d):
    return joins.anti(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("j5_left_default", """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE d.doc_id WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS sort_key
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j5(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    out = joins.left_default(docs, table(spark, d, "labels").select("doc_id", "quality"), "doc_id", {"quality": -1}, [3, 1, 2])
    return out.select("doc_id", "quality", F.col("sort_key").cast("int").alias("sort_key"))


@query("j6_terms_for_species", """SELECT c_custkey AS member FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7')""")
def j6(spark, d):
    links = table(spark, d, "customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("species_id"))
    species = table(spark, d, "nation").select(F.col("n_nationkey").alias("species_id"), F.col("n_name").alias("species_name"))
    return joins.terms_for_species(links, species, "NATION_7")


@query("j7_paths", _with(CLOSURE_SQL, recursive=True) + """SELECT ancestor, descendant, distance, 'name ' || ancestor AS ancestor_name,
  'name ' || descendant AS descendant_name FROM (SELECT DISTINCT * FROM paths)""")
def j7(spark, d):
    terms = _term_dim(spark, d).select("term", F.concat(F.lit("name "), "term").alias("name"))
    return joins.paths(ontology.closure(dag(spark, d)), terms)


@query("j8_resolve", """SELECT p_partkey AS id, coalesce(r_name, p_type) AS term FROM part LEFT JOIN
  (SELECT 'PROMO' AS synonym, r_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'SMALL', r_name FROM region WHERE r_regionkey = 2)
  ON p_type = synonym""")
def j8(spark, d):
    syn = table(spark, d, "region").filter("r_regionkey IN (1, 2)").select(
        F.when(F.col("r_regionkey") == 1, "PROMO").otherwise("SMALL").alias("synonym"), F.col("r_name").alias("term"))
    return joins.resolve(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("term")), syn)


@query("j10_predict", """WITH md AS (SELECT DISTINCT p_brand AS motif, 's' || l_suppkey AS h1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_size < 5),
  e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
  h AS (SELECT DISTINCT p_brand AS motif, 'p' || p_partkey AS h2 FROM part)
  SELECT DISTINCT motif, h1, h2 FROM md JOIN e ON e.a = h1 JOIN h USING (motif) WHERE h2 = e.b AND h1 <> h2""")
def j10(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    md = li.filter("l_returnflag = 'R'").join(p.filter("p_size < 5"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("motif"), F.concat(F.lit("s"), "l_suppkey").alias("h1"))
    hits = p.select(F.col("p_brand").alias("motif"), F.concat(F.lit("p"), "p_partkey").alias("h2"))
    return joins.predict(md, edges(spark, d), hits)


@query("j11_expand_by_domain", """WITH a AS (SELECT p_type AS domain, p_name AS protein FROM part),
  pairs AS (SELECT DISTINCT p_brand AS motif, p_type AS domain FROM part WHERE p_size > 48)
  SELECT DISTINCT motif, protein FROM (SELECT p_brand AS motif, p_name AS protein FROM part UNION ALL SELECT motif, protein FROM pairs JOIN a USING (domain))""")
def j11(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_name", "p_type", "p_size").distinct()
    known = p.select(F.col("p_brand").alias("motif"), F.col("p_name").alias("protein"))
    pairs = p.filter("p_size > 48").select(F.col("p_brand").alias("motif"), F.col("p_type").alias("domain")).distinct()
    annots = p.select(F.col("p_type").alias("domain"), F.col("p_name").alias("gene")).distinct()
    return joins.expand_by_domain(known, pairs, annots)


def _relations(spark, d):
    rel = table(spark, d, "nation").select(
        F.concat(F.lit("r"), "n_regionkey").alias("entry1"), F.concat(F.lit("n"), "n_nationkey").alias("entry2"),
        F.lit("contains").alias("rel_type"), F.array(F.lit("x"), F.lit("y")).alias("subtypes"))
    members = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("entry"), F.concat(F.lit("s"), "s_suppkey").alias("gene")).union(
        table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.col("r_name")))
    return rel, members


_REL_SQL = """rel AS (SELECT 'r' || n_regionkey AS entry1, 'n' || n_nationkey AS entry2 FROM nation),
  members AS (SELECT 'n' || s_nationkey AS entry, 's' || s_suppkey AS gene FROM supplier UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
  sub AS (SELECT unnest(['x', 'y']) AS rel_subtype)"""


@query("j12_expand_relations", _with(_REL_SQL) + """SELECT DISTINCT m1.gene AS a, m2.gene AS b, 'contains' AS rel_type, rel_subtype
  FROM rel JOIN members m1 ON m1.entry = entry1 JOIN members m2 ON m2.entry = entry2, sub""")
def j12(spark, d):
    return joins.expand_relations(*_relations(spark, d))


@query("j13_expand_with_complex", _with(_REL_SQL, """cx AS (SELECT 's' || s_suppkey AS gene, 'big' AS cplx FROM supplier WHERE s_acctbal > 5000)""",
  """m AS (SELECT DISTINCT entry, coalesce(cplx, members.gene) AS gene FROM members LEFT JOIN cx USING (gene))""",
  """e AS (SELECT DISTINCT m1.gene AS a, m2.gene AS b, rel_subtype FROM rel JOIN m m1 ON m1.entry = entry1 JOIN m m2 ON m2.entry = entry2, sub)""")
  + "SELECT a, b, 'contains' AS rel_type, rel_subtype FROM e UNION SELECT b, a, 'contains', rel_subtype FROM e")
def j13(spark, d):
    alias = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("s"), "s_suppkey").alias("gene"), F.lit("big").alias("complex"))
    return joins.expand_relations(*_relations(spark, d), alias=alias, symmetric=True)


@query("j14_map_ids", """SELECT l_partkey AS key, p_size AS id, p_size IS NOT NULL AS known FROM (SELECT DISTINCT l_partkey FROM lineitem)
  LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""")
def j14(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    m = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("id"))
    return joins.map_ids(ids, m)


@query("j15_all_pairs", _with(LISTS_SQL, "ids AS (SELECT DISTINCT set_id FROM lists)",
  "n AS (SELECT a.set_id AS i, b.set_id AS j, count(*) AS c FROM lists a JOIN lists b USING (item) WHERE a.set_id < b.set_id GROUP BY 1, 2)")
  + "SELECT x.set_id AS i, y.set_id AS j, coalesce(c, -1) AS shared FROM ids x JOIN ids y ON x.set_id < y.set_id LEFT JOIN n ON n.i = x.set_id AND n.j = y.set_id")
def j15(spark, d):
    return joins.all_pairs(lists(spark, d))


@query("j16_range_join", """SELECT o_orderkey, s_suppkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey
  AND o_totalprice / 50 >= s_acctbal AND o_totalprice / 50 < s_acctbal + 200""")
def j16(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("nation"), (F.col("o_totalprice") / 50).alias("pos"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 200).alias("hi"))
    return joins.range_join(o, s, ["nation"], "pos", "lo", "hi").select("o_orderkey", "s_suppkey")


@query("j17_band_join", """SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) < 100""")
def j17(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return joins.band_join(c, s, ["nation"], "c_acctbal", "s_acctbal", 100.0).select("c_custkey", "s_suppkey")


@query("m27_nearest_site", """SELECT c_custkey, nation, pos, site, site - pos AS distance FROM (
  SELECT c_custkey, c_nationkey AS nation, c_acctbal AS pos, s_acctbal AS site,
    row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_acctbal) AS r
  FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(s_acctbal - c_acctbal) <= 500) WHERE r = 1""")
def m27(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("pos"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("site"))
    return joins.nearest_join(c, s, ["nation"], 500.0)


@query("j18_asof_pair", _with(TIMELINE_SQL, "tl AS (SELECT pat, week, round(avg(val), 6) AS val FROM timeline GROUP BY 1, 2)",
  "asked AS (SELECT DISTINCT pat, t AS time FROM tl, (SELECT unnest([5, 12, 20]) AS t))")
  + """SELECT pat, CAST(time AS INTEGER) AS time, p.week AS prev_week, p.val AS prev_val, n.week AS next_week, n.val AS next_val FROM asked
  LEFT JOIN LATERAL (SELECT week, val FROM tl WHERE tl.pat = asked.pat AND week <= time ORDER BY week DESC LIMIT 1) p ON true
  LEFT JOIN LATERAL (SELECT week, val FROM tl WHERE tl.pat = asked.pat AND week >= time ORDER BY week LIMIT 1) n ON true""")
def j18(spark, d):
    tl = timeline(spark, d).groupBy("pat", "week").agg(F.round(F.avg("val"), 6).alias("val"))
    return joins.asof_pair(tl, [5, 12, 20], ["pat"])


@query("j19_by_digest", """SELECT d.doc_id, c.conv_id, c.turn FROM documents d JOIN conversations c ON md5(d.text) = md5(c.text)""")
def j19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("said"))
    return joins.by_digest(docs, turns, "text", "said").select("doc_id", "conv_id", "turn")


_DRUGSETS_SQL = REGIMEN_SQL + ", sets AS (SELECT pat, start, list(DISTINCT drug) AS drugs FROM regimen GROUP BY 1, 2)"


def _drug_sets(spark, d):
    return regimen(spark, d).groupBy("pat", "start").agg(F.sort_array(F.collect_set("drug")).alias("drugs"))


@query("j20_took", _with(_DRUGSETS_SQL) + "SELECT pat, start FROM sets WHERE list_contains(drugs, 'Brand#3') AND list_contains(drugs, 'Brand#5')")
def j20(spark, d):
    return joins.took(_drug_sets(spark, d), ["Brand#3", "Brand#5"]).select("pat", "start")


@query("j21_hit_boxes", "SELECT DISTINCT p_brand AS box FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def j21(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("box"), F.col("p_partkey").alias("gene"))
    return joins.hit_boxes(m, table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("gene")))


@query("j22_pair_all", "SELECT r_name, doc_id FROM region, documents")
def j22(spark, d):
    return joins.pair_all(table(spark, d, "region").select("r_name"), table(spark, d, "documents").select("doc_id"))


# --- aggregates -------------------------------------------------------------

@query("a1_score_list", """SELECT p_type AS motif, count(l_orderkey) AS n FROM part LEFT JOIN
  (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)) ON l_partkey = p_partkey GROUP BY 1""")
def a1(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("motif"))
    annots = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gene"), "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    ids = table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("gene"))
    return agg.score_list(ids, annots.select("gene", "motif"), p)


@query("a2_by_category", """SELECT p_type AS category, p_brand AS term, count(DISTINCT p_name) AS "count",
  string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS genes FROM part GROUP BY 1, 2""")
def a2(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("term"), F.col("p_name").alias("gene"))
    return agg.by_category(p).withColumn("genes", F.concat_ws(",", "genes"))


def _spans(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("motif"),
        F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("int").alias("end"), F.col("l_linestatus").alias("tool"))


@query("a3_index_by", """SELECT l_suppkey AS gene, l_returnflag AS motif, count(*) AS n_spans, min(l_linenumber) AS first_start FROM
  (SELECT DISTINCT l_suppkey, l_returnflag, l_linenumber, l_quantity FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1, 2""")
def a3(spark, d):
    idx = agg.index_by(_spans(spark, d), "gene", "motif", {"tool": ["F"]})
    return idx.select("gene", "motif", F.size("spans").cast("long").alias("n_spans"), F.col("spans")[0]["start"].alias("first_start"))


@query("a4_dedupe_spans", """SELECT l_suppkey AS gene, l_linenumber AS start, CAST(l_quantity AS INTEGER) AS "end", min(l_returnflag || l_linestatus) AS tag
  FROM lineitem GROUP BY 1, 2, 3""")
def a4(spark, d):
    out = agg.dedupe_spans(_spans(spark, d), ["gene"])
    return out.select("gene", "start", "end", F.concat("motif", "tool").alias("tag"))


@query("a8_avg_duplicates", _with(TIMELINE_SQL) + "SELECT pat, kind, week, round(avg(val), 6) AS val FROM timeline GROUP BY 1, 2, 3")
def a8(spark, d):
    return agg.avg_duplicates(timeline(spark, d), ["pat", "kind"]).withColumn("val", F.round("val", 6))


@query("a10_collapse", _with(EXPR_SQL) + """SELECT 'c' || (CAST(substring(gene, 2) AS INTEGER) // 8) AS gene, sample, round(median(value), 6) AS value
  FROM expr GROUP BY 1, 2""")
def a10(spark, d):
    e = expr(spark, d).select(F.col("gene").alias("probe"), "sample", "value")
    genes = e.select("probe").distinct().select("probe", F.concat(F.lit("c"), F.floor(F.substring("probe", 2, 9).cast("int") / 8)).alias("gene"))
    return agg.collapse(e, genes).withColumn("value", F.round("value", 6))


@query("a11_aggregate_rows", """SELECT lang, source, toxic, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0,
  CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1 FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR lang = 'en' GROUP BY 1, 2, 3""")
def a11(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.filter("quality IS NOT NULL OR lang = 'en'").withColumn("resp", F.col("quality") == 1)
    out = agg.aggregate_rows(rows, ["lang", "source", "toxic"], "resp")
    return out


@query("a12_cohort_stats", """SELECT lang AS study, source AS therapy, count(*) AS n_patients, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_responders,
  count(quality) AS n_sequences, CAST(grouping(lang, source) AS BIGINT) AS grain FROM documents LEFT JOIN labels USING (doc_id)
  GROUP BY GROUPING SETS ((lang), (source), ())""")
def a12(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("pat"), F.col("lang").alias("study"), F.col("source").alias("therapy"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("responder"), F.col("quality").isNotNull().alias("has_seq"))
    return agg.cohort_stats(p)


@query("a13_initial_therapy", _with(REGIMEN_SQL, "first AS (SELECT pat, min(start) AS start FROM regimen WHERE start >= 0 GROUP BY 1)")
  + """SELECT c_custkey AS pat, coalesce(therapy, 'Discarded') AS therapy FROM customer LEFT JOIN
  (SELECT pat, string_agg(DISTINCT drug, ', ' ORDER BY drug) AS therapy FROM regimen JOIN first USING (pat, start) GROUP BY 1) t ON t.pat = c_custkey""")
def a13(spark, d):
    return agg.initial_therapy(regimen(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("pat")))


@query("a14_therapy_hist", _with(REGIMEN_SQL, "sets AS (SELECT pat, start, string_agg(DISTINCT drug, '+' ORDER BY drug) AS drugs FROM regimen GROUP BY 1, 2)")
  + """SELECT drugs, CAST(sum(CASE WHEN start < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_before,
  CAST(sum(CASE WHEN start BETWEEN 0 AND 24 THEN 1 ELSE 0 END) AS BIGINT) AS n_during FROM sets GROUP BY 1 HAVING n_before + n_during >= 5""")
def a14(spark, d):
    r = _drug_sets(spark, d).withColumn("drugs", F.concat_ws("+", "drugs"))
    return agg.therapy_hist(r, 24, 5)


@query("a15_regimen_cohorts", _with(REGIMEN_SQL, "pd AS (SELECT DISTINCT pat, drug FROM regimen WHERE start BETWEEN 0 AND 24)") + """
  SELECT drug AS drugs, count(*) AS n_patients FROM pd GROUP BY 1 HAVING count(*) >= 20
  UNION ALL SELECT a.drug || '+' || b.drug, count(*) FROM pd a JOIN pd b ON a.pat = b.pat AND a.drug < b.drug GROUP BY 1 HAVING count(*) >= 20
  UNION ALL SELECT a.drug || '+' || b.drug || '+' || c.drug, count(*) FROM pd a JOIN pd b ON a.pat = b.pat AND a.drug < b.drug
    JOIN pd c ON c.pat = b.pat AND b.drug < c.drug GROUP BY 1 HAVING count(*) >= 20""")
def a15(spark, d):
    r = regimen(spark, d).filter(F.col("start").between(0, 24))
    return agg.regimen_cohorts(r, 20).withColumn("drugs", F.concat_ws("+", "drugs"))


@query("a16_contingency", """SELECT *, CAST(sum(n) OVER (PARTITION BY p_type) AS BIGINT) AS row_total, CAST(sum(n) OVER (PARTITION BY p_brand) AS BIGINT) AS col_total
  FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)""")
def a16(spark, d):
    return agg.contingency(table(spark, d, "part"), "p_type", "p_brand")


@query("a17_membership_matrix", """SELECT p_name AS probe, bool_or(p_type = 'PROMO') AS "PROMO", bool_or(p_type = 'SMALL') AS "SMALL",
  bool_or(p_type = 'LARGE') AS "LARGE" FROM part GROUP BY 1""")
def a17(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("probe"), F.col("p_type").alias("term"))
    return agg.membership_matrix(p, ["PROMO", "SMALL", "LARGE"])


@query("a18_common_times", _with(TIMELINE_SQL) + """SELECT week FROM (SELECT week FROM timeline WHERE week > 0 GROUP BY 1 ORDER BY count(*) DESC, week LIMIT 4)
  UNION ALL SELECT 0""")
def a18(spark, d):
    return agg.common_times(timeline(spark, d), 5)


@query("a19_term_lists", """SELECT p_name AS gene, coalesce(string_agg(DISTINCT CASE WHEN p_type = 'PROMO' THEN p_brand END, ',' ORDER BY CASE WHEN p_type = 'PROMO' THEN p_brand END), '') AS "PROMO",
  coalesce(string_agg(DISTINCT CASE WHEN p_type = 'LARGE' THEN p_brand END, ',' ORDER BY CASE WHEN p_type = 'LARGE' THEN p_brand END), '') AS "LARGE" FROM part GROUP BY 1""")
def a19(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("term"), F.col("p_name").alias("gene"))
    out = agg.term_lists(agg.by_category(p), ["PROMO", "LARGE"])
    return out.select("gene", F.concat_ws(",", "PROMO").alias("PROMO"), F.concat_ws(",", "LARGE").alias("LARGE"))


@query("a20_partition_modes", """WITH parts AS (SELECT l_suppkey AS iter, p_partkey AS sample, p_type AS cluster FROM part JOIN (SELECT DISTINCT l_suppkey FROM lineitem) ON l_suppkey % 2 = 0
  UNION ALL SELECT l_suppkey, p_partkey, p_brand FROM part JOIN (SELECT DISTINCT l_suppkey FROM lineitem) ON l_suppkey % 2 = 1)
  SELECT min(iter) AS first_iter, n_clusters, count(*) AS n, round(count(*) / (SELECT count(DISTINCT iter) FROM parts), 6) AS share FROM
  (SELECT iter, count(DISTINCT cluster) AS n_clusters FROM parts GROUP BY 1) GROUP BY n_clusters""")
def a20(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample"), "p_type", "p_brand")
    iters = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("iter")).distinct()
    parts = joins.pair_all(iters, spread(p)).select(
        "iter", "sample", F.when(F.col("iter") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("cluster"))
    return agg.partition_modes(parts, 5).withColumn("share", F.round("share", 6))


@query("a21_significant", _with(_CHART_SQL) + """SELECT DISTINCT p_name AS gene FROM part WHERE (p_type, p_brand) IN (SELECT category, term FROM chart WHERE pvalue < 0.0445)""")
def a21(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("term"), F.col("p_name").alias("gene"))
    chart = agg.by_category(p).drop("count").join(_chart(spark, d), ["category", "term"])
    return agg.significant(chart, 0.0445)


@query("a22_prediction_sets", """WITH pr AS (SELECT DISTINCT l_returnflag AS virus, l_linestatus AS motif, 's' || l_suppkey AS h1, 'p' || l_partkey AS h2 FROM lineitem),
  g AS (SELECT virus, motif, h1, h2 FROM pr UNION ALL SELECT virus, 'all', h1, h2 FROM pr UNION ALL SELECT 'all', 'all', h1, h2 FROM pr),
  r AS (SELECT virus, motif, 'H1' AS role, h1 AS m FROM g UNION ALL SELECT virus, motif, 'H2', h2 FROM g UNION ALL SELECT virus, motif, 'H12', h1 FROM g
    UNION ALL SELECT virus, motif, 'H12', h2 FROM g UNION ALL SELECT virus, motif, 'H1toH2', h1 || '>' || h2 FROM g)
  SELECT virus, motif, role, count(DISTINCT m) AS n FROM r GROUP BY 1, 2, 3""")
def a22(spark, d):
    pr = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("virus"), F.col("l_linestatus").alias("motif"),
        F.concat(F.lit("s"), "l_suppkey").alias("h1"), F.concat(F.lit("p"), "l_partkey").alias("h2")).distinct()
    return agg.prediction_sets(pr)


@query("a23_summarise_runs", """SELECT p_brand AS feature, round(avg(sign(w)), 9) AS mean_sign, round(avg(abs(w)), 9) AS mean_abs, round(stddev_samp(w), 9) AS sd, count(*) AS n_runs
  FROM (SELECT p_brand, l_discount - 0.05 AS w FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def a23(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    runs = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("feature", (F.col("l_discount") - 0.05).alias("weight"))
    out = agg.summarise_runs(runs)
    return out.select("feature", *[F.round(c, 9).alias(c) for c in ("mean_sign", "mean_abs", "sd")], "n_runs")


@query("f6_patient_field", _with(REGIMEN_SQL) + "SELECT c_custkey AS pat, drug AS drugs FROM customer LEFT JOIN (SELECT DISTINCT pat, drug FROM regimen WHERE start >= 0) r ON r.pat = c_custkey")
def f6(spark, d):
    taken = regimen(spark, d).filter("start >= 0").groupBy("pat").agg(F.collect_set("drug").alias("drugs"))
    patients = table(spark, d, "customer").select(F.col("c_custkey").alias("pat")).join(taken, "pat", "left")
    return agg.patient_field(patients, "drugs", "explode")
