"""How the given tables stand for sequences, lists, networks, expression and patients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.plans.registry import table
from strandframe.session import spread

#: Small motif dictionary of the registered queries.
MOTIFS = [
    ("tion", "tion"), ("vowel3", "[aeiou][aeiou][aeiou]"), ("the", "the"),
    ("s_s", "s.s"), ("en_dt", "en[dt]"), ("not_h", "t[^ho]e"),
]


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("seq_id"), F.lower("text").alias("seq"))


SEQS_SQL = "seqs AS (SELECT doc_id AS seq_id, lower(text) AS seq FROM documents)"


def lists(spark, sf_dir) -> DataFrame:
    """Gene lists: the parts of each supplier."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("item")).distinct()


LISTS_SQL = "lists AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS item FROM lineitem)"


def edges(spark, sf_dir) -> DataFrame:
    """Symmetric network of suppliers and parts."""
    one = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()
    return one.union(one.select("b", "a"))


EDGES_SQL = """one AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
edges AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one)"""


def dag(spark, sf_dir) -> DataFrame:
    """Ontology: customers and suppliers under nations, nations under regions, regions under a root."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("root").alias("parent"))
    return c.union(s).union(n).union(r)


DAG_SQL = """dag AS (
  SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"""

#: Recursive closure of the ontology, reflexive.
CLOSURE_SQL = DAG_SQL + """, paths AS (
  SELECT t AS ancestor, t AS descendant, 0 AS distance FROM (SELECT child AS t FROM dag UNION SELECT parent FROM dag)
  UNION ALL
  SELECT d.parent, p.descendant, p.distance + 1 FROM paths p JOIN dag d ON d.child = p.ancestor)"""


def timeline(spark, sf_dir) -> DataFrame:
    """Clinical series: one reading per event, time in days from the first of January 2024."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pat"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("week"),
        F.col("event_type").alias("kind"), F.col("value").alias("val"))


TIMELINE_SQL = """timeline AS (SELECT user_id AS pat, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS week,
  event_type AS kind, value AS val FROM events)"""


def regimen(spark, sf_dir) -> DataFrame:
    """Drug exposure: part brands by customer, start in weeks from January 1998."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
        .select(F.col("o_custkey").alias("pat"),
                F.floor(F.datediff("l_shipdate", F.lit("1998-01-01").cast("date")) / 7).cast("int").alias("start"),
                F.col("p_brand").alias("drug"))
    )


REGIMEN_SQL = """regimen AS (SELECT o_custkey AS pat,
  CAST(floor(date_diff('day', DATE '1998-01-01', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS start, p_brand AS drug
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def expr(spark, sf_dir) -> DataFrame:
    """Expression: embedding positions as genes, vectors as samples, labels as classes."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample"), F.col("label").alias("cls"), F.posexplode("embedding").alias("_g", "_v")
    ).select(F.concat(F.lit("g"), F.col("_g")).alias("gene"), "sample", F.col("_v").cast("double").alias("value"), "cls")


EXPR_SQL = """expr AS (SELECT 'g' || (g - 1) AS gene, vec_id AS sample, CAST(embedding[g] AS DOUBLE) AS value, label AS cls
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS g FROM embeddings))"""


def pileup(spark, sf_dir) -> DataFrame:
    """Columns of documents laid on the lowest-numbered document, letter by letter."""
    from strandframe.operators.pileup import trivial_pileup
    return trivial_pileup(seqs(spark, sf_dir))


PILEUP_SQL = """docs AS (SELECT doc_id AS seq_id, string_split(lower(text), '') AS letters FROM documents),
ref AS (SELECT letters AS ref_letters FROM docs ORDER BY seq_id LIMIT 1),
pileup AS (SELECT seq_id, CAST(i - 1 AS INTEGER) AS ref_pos, letters[i] AS base, coalesce(ref_letters[i], '-') AS ref_base,
  letters[i] = coalesce(ref_letters[i], '-') AS is_match
  FROM (SELECT seq_id, letters, ref_letters, unnest(range(1, len(letters) + 1)) AS i FROM docs, ref)), everyone AS (SELECT count(DISTINCT seq_id) AS n_all FROM pileup)"""
