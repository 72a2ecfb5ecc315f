"""Registered queries of this subpackage and, where SQL can say it, their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm import chat, classlm, decontam, html, langid, lines, mixing, quality, runs, simhash, trie, urls, warc
from strandframe.plans.registry import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


_LINES = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i+1] || chr(10) || ls[i+2] || chr(10) || ls[i+3] AS k
      FROM d, unnest(range(len(ls) - 2)) u(i) WHERE len(ls) >= 3 AND ls[i+1] || ls[i+2] || ls[i+3] <> ''),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, unnest([0, 1, 2]) u(j)),
l AS (SELECT d.doc_id, i, ls[i+1] AS line FROM d, unnest(range(len(ls))) u(i)),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS text,
      count(*) AS n_lines, count(gone.i) AS removed_lines
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, n_lines, removed_lines
FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""


@query("op1_line_dedup", _LINES)
def op1_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "removed_lines")


def _mixing_sql(rounds: int = 60) -> str:
    t = mixing.TEMPER
    rule = " ".join(
        f"WHEN length(text) > 0 AND len(regexp_extract_all(text, '{p}')) >= length(text) * {s!r} THEN '{n}'"
        for n, p, s in mixing.TOPIC_RULES)
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS s, coalesce('=' || lang, 'null') AS l, source, lang,
    CASE {rule} ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents),
c AS (SELECT s, l, topic AS t, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
ts AS (SELECT s, p / sum(p) OVER () AS share FROM (SELECT s, pow(sum(n), {t['source']}) AS p FROM c GROUP BY s)),
tl AS (SELECT l, p / sum(p) OVER () AS share FROM (SELECT l, pow(sum(n), {t['lang']}) AS p FROM c GROUP BY l)),
tt AS (SELECT t, p / sum(p) OVER () AS share FROM (SELECT t, pow(sum(n), {t['topic']}) AS p FROM c GROUP BY t)),
base AS (SELECT c.*, ts.share AS ss, tl.share AS ls, tt.share AS st FROM c JOIN ts USING (s) JOIN tl USING (l) JOIN tt USING (t)),
r AS (
  SELECT 0 AS k, s, l, t, n, ss, ls, st, n AS w FROM base
  UNION ALL
  SELECT k + 1, s, l, t, n, ss, ls, st, w * st / sum(w) OVER (PARTITION BY t) FROM (
    SELECT k, s, l, t, n, ss, ls, st, w * ls / sum(w) OVER (PARTITION BY l) AS w FROM (
      SELECT k, s, l, t, n, ss, ls, st, w * ss / sum(w) OVER (PARTITION BY s) AS w FROM r WHERE k < {rounds}))),
f AS (SELECT s, l, t, w / n * sum(n) OVER () AS weight, w / n / max(w / n) OVER () AS p FROM r WHERE k = {rounds})
SELECT doc_id, source, lang, topic, n_tokens,
  round(CASE WHEN n_tokens > 0 THEN weight ELSE 0 END, 6) AS weight,
  round(CASE WHEN n_tokens > 0 THEN p ELSE 0 END, 6) AS probability,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < CASE WHEN n_tokens > 0 THEN p ELSE 0 END AS sampled
FROM d LEFT JOIN f ON d.s = f.s AND d.l = f.l AND d.topic = f.t"""


@query("op2_mix_sources", _mixing_sql())
def op2_mix_sources(spark, sf_dir):
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"),
                      F.round("probability", 6).alias("probability"), "sampled")


#: The rules (verdict, host, path) and the listed names, each under three endings.
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"))
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_HOSTS = tuple(f"{n}.example.{e}" for n in LISTED_NAMES for e in ("com", "net", "org"))

_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
_URLS = f"""
WITH rules(v, h, p) AS (VALUES {_values(URL_RULES)}), hosts(h) AS (VALUES {_values([(h,) for h in LISTED_HOSTS])}),
u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
fits AS (
  SELECT u.*, (SELECT max(struct_pack(n := length(h || p), nh := length(h), v := CASE v WHEN 'allow' THEN 1 ELSE 0 END, rule := h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r,
    (SELECT max(struct_pack(n := length(h), h := h)) FROM hosts WHERE host = h OR ends_with(host, '.' || h)) AS l FROM u)
SELECT page_id, host, path, r.rule AS rule,
  CASE WHEN r IS NOT NULL THEN CASE r.v WHEN 1 THEN 'allow' ELSE 'block' END WHEN l IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  l.h AS listed_host
FROM fits"""


@query("op3_url_filters", _URLS)
def op3_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(list(URL_RULES), "verdict string, host string, path string")
    hosts = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "host string")
    out = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, hosts)
    return out.select("page_id", "host", "path", "rule", "verdict", "listed_host")


@query("op4_warc")
def op4_warc(spark, sf_dir):
    manifest, folder = warc.write_archives(table(spark, sf_dir, "pages"))
    kind = table(spark, sf_dir, "pages").schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return warc.read_archives(spark, manifest, folder, payloads=False).select(
        number("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


@query("op5_simhash_pivots")
def op5_simhash_pivots(spark, sf_dir):
    found = simhash.classify(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


@query("op6_decontaminate")
def op6_decontaminate(spark, sf_dir):
    return decontam.leaks_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    out = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.round("good_probability", 6).alias("good_probability"))


@query("op9_html_density")
def op9_html_density(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    out = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))


@query("op11_class_bigrams")
def op11_class_bigrams(spark, sf_dir):
    out = classlm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: CRC-32 of a text bit by bit, as a DuckDB macro would have it; the polynomial is a fixed value.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::INT, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)),
  4294967295::BIGINT)"""

_TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations),
h AS (SELECT c, {_CRC.format(x='c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (
  SELECT h.c, 0 AS part, t.k, t.r, t.x FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.k <= h.h
  UNION ALL SELECT h.c, 1, t.k, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.k > h.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, md5(r) || md5(x) AS turn, length(x) AS n FROM b),
p AS (SELECT c, d, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS path, n FROM s
      UNION ALL SELECT c, 0, '', 0 FROM h),
e AS (SELECT c, max(d) AS last FROM p GROUP BY c),
node AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, min(n) AS n,
    string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last) AS ends
  FROM p JOIN e USING (c) GROUP BY path, d),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
known AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
up AS (SELECT left(path, u.i * 64) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
       FROM known, unnest(range(d + 1)) u(i) GROUP BY 1)
SELECT k.conv_id, k.d AS depth, above.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM known k JOIN up USING (path) LEFT JOIN node above ON k.d > 0 AND above.path = left(k.path, length(k.path) - 64)"""


@query("op12_prefix_trie", _TRIE)
def op12_prefix_trie(spark, sf_dir):
    turns = trie.number_turns(table(spark, sf_dir, "conversations"))
    out = trie.prefix_trie(trie.share_heads(turns))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.repeat_parts(F.col("doc_id"), F.col("text")).alias("text"))
    out = runs.periodic_runs(docs)
    return out.select("doc_id", *[c.alias(n) for n, c in runs.digests(F.col("runs"), F.col("collapsed")).items()])


_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, length(replace(replace(replace(t, '\', '\0'), '<', '\1'), '>', '\2')) AS nt,
    length(replace(replace(replace(r, '\', '\0'), '<', '\1'), '>', '\2')) AS nr,
    lag(r) OVER o IS NOT DISTINCT FROM r AS more, lead(r) OVER o IS NOT DISTINCT FROM r AS goes_on
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(nt + CASE WHEN more THEN 6 ELSE 7 + nr END + CASE WHEN goes_on THEN 0 ELSE 7 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op8_chat_format", _CHAT)
def op8_chat_format(spark, sf_dir):
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.format_chats(rows).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
