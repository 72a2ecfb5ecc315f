"""Queries on patient timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.operators import clinical as cl
from strandframe.operators.aggregates import avg_duplicates, initial_therapy
from strandframe.plans.registry import query, table
from strandframe.plans.views import REGIMEN_SQL, TIMELINE_SQL, regimen, timeline
from strandframe.session import run_path

_TL = "WITH " + TIMELINE_SQL + ", tl AS (SELECT pat, kind, week, avg(val) AS val FROM timeline GROUP BY 1, 2, 3)"


def _at(times: list[int], where: str = "true") -> str:
    """SQL for linear values at the given times, NULL outside the range."""
    return _TL + f""", asked AS (SELECT DISTINCT pat, kind, t AS time FROM tl, (SELECT unnest({times}) AS t) WHERE {where}),
  lo AS (SELECT a.pat, a.kind, a.time, max(week) AS pw, max_by(val, week) AS pv FROM asked a JOIN tl USING (pat, kind) WHERE week <= time GROUP BY 1, 2, 3),
  hi AS (SELECT a.pat, a.kind, a.time, min(week) AS nw, min_by(val, week) AS nv FROM asked a JOIN tl USING (pat, kind) WHERE week >= time GROUP BY 1, 2, 3),
  vals AS (SELECT a.pat, a.kind, CAST(a.time AS INTEGER) AS time, CASE WHEN nw = pw THEN pv ELSE pv + (nv - pv) * (a.time - pw) / (nw - pw) END AS val
    FROM asked a LEFT JOIN lo USING (pat, kind, time) LEFT JOIN hi USING (pat, kind, time))"""


def _wide(times: list[int]) -> str:
    cols = ", ".join(f"max(CASE WHEN time = {t} THEN val END) AS t{t}" for t in times)
    return f", wide AS (SELECT pat, {cols} FROM vals GROUP BY 1)"


@query("c1_timeline", "WITH " + TIMELINE_SQL + " SELECT pat, week, kind, val FROM timeline WHERE kind IN ('click', 'view')")
def c1(spark, d):
    tl = timeline(spark, d)
    return cl.timeline({k: tl.filter(F.col("kind") == k) for k in ("click", "view")})


@query("c2_covers", _TL + """, s AS (SELECT pat, kind, min(week) AS lo, max(week) AS hi FROM tl WHERE kind IN ('click', 'view') GROUP BY 1, 2)
  SELECT pat FROM s WHERE lo <= 4 AND hi >= 24 GROUP BY 1 HAVING count(*) = 2""")
def c2(spark, d):
    return cl.covers(timeline(spark, d), 4, 24, ["click", "view"])


@query("c3_value_at", _at([2, 9, 17, 28]) + " SELECT pat, kind, time, round(val, 6) AS val FROM vals")
def c3(spark, d):
    return cl.value_at(timeline(spark, d), [2, 9, 17, 28]).withColumn("val", F.round("val", 6))


@query("c4_responder_sd", _at([0, 8], "kind = 'click'") + _wide([0, 8]) + " SELECT pat, t8 / t0 < 0.8 AS responder FROM wide")
def c4(spark, d):
    return cl.responder_sd(timeline(spark, d), "click", 0.8)


@query("c5_responder_wnd", _at(cl.WINDOW_TIMES, "kind = 'view'") + _wide(cl.WINDOW_TIMES)
  + ", s AS (SELECT pat, " + " + ".join(f"CASE WHEN t{b} - t{a} <= 0 THEN 1 ELSE 0 END" for a, b in zip(cl.WINDOW_TIMES, cl.WINDOW_TIMES[1:])) + " AS n_steps FROM wide) SELECT pat, n_steps, n_steps > 3 AS responder FROM s")
def c5(spark, d):
    return cl.responder_wnd(timeline(spark, d), "view")


@query("c6_responder_drop", _at([0, 8], "kind = 'error'") + _wide([0, 8]) + """, n AS (SELECT pat, count(DISTINCT week) AS n FROM timeline WHERE kind = 'error' GROUP BY 1)
  SELECT pat, coalesce(t8 - t0 <= -1.5, false) AND n >= 3 AS responder FROM wide JOIN n USING (pat)""")
def c6(spark, d):
    return cl.responder_drop(timeline(spark, d), "error")


_GRID = [2, 6, 10, 14, 18, 22, 26]


@query("c7_responder_share", _at(_GRID, "kind = 'signup'") + _wide(_GRID)
  + ", s AS (SELECT pat, (" + " + ".join(f"CASE WHEN t{b} - t{a} < 0 THEN 1 ELSE 0 END" for a, b in zip(_GRID, _GRID[1:])) + ") / 6.0 AS share, ("
  + " + ".join(f"CASE WHEN t{b} - t{a} IS NULL THEN 1 ELSE 0 END" for a, b in zip(_GRID, _GRID[1:])) + ") / 6.0 AS gone FROM wide) SELECT pat, round(CAST(share AS DOUBLE), 9) AS share, share >= 0.4 AND gone < 0.8 AS responder FROM s")
def c7(spark, d):
    return cl.responder_share(timeline(spark, d), "signup", _GRID).withColumn("share", F.round("share", 9))


@query("c8_normalise", _at(_GRID) + " SELECT pat, kind, time, round(CASE WHEN val >= 0 THEN val END, 6) AS val FROM vals")
def c8(spark, d):
    return cl.normalise(timeline(spark, d), _GRID).withColumn("val", F.round("val", 6))


@query("c8_normalise_spline")
def c8b(spark, d):
    return cl.normalise(timeline(spark, d), _GRID, spline=True)


@query("c12_split_groups", """SELECT DISTINCT user_id AS pat, user_id % 3 = 0 AS responder FROM events""")
def c12(spark, d):
    path = run_path(spark)
    pats = table(spark, d, "events").select(F.col("user_id").alias("pat")).distinct()
    cl.split_groups(pats, pats.withColumn("responder", F.col("pat") % 3 == 0), path)
    return spark.read.parquet(path).select("pat", F.col("responder").cast("boolean").alias("responder"))


@query("c9_took_drugs", "WITH " + REGIMEN_SQL + """, sets AS (SELECT pat, start, list(DISTINCT drug) AS drugs FROM regimen GROUP BY 1, 2)
  SELECT DISTINCT pat FROM sets WHERE start = 0 AND list_contains(drugs, 'Brand#4')""")
def c9(spark, d):
    sets = regimen(spark, d).groupBy("pat", "start").agg(F.collect_set("drug").alias("drugs"))
    return cl.took_drugs(sets, ["Brand#4"])


@query("c10_group_hist", _at(_GRID, "kind = 'click'") + """, grp AS (SELECT pat, pat % 2 = 0 AS grp FROM (SELECT DISTINCT pat FROM timeline)), sz AS (SELECT grp, count(*) AS size FROM grp GROUP BY 1)
  SELECT grp, time, CAST(CASE WHEN val >= 150 THEN 16 ELSE floor(val / 10) + 1 END AS INTEGER) AS bin, count(*) AS n, round(count(*) / max(size), 9) AS share FROM vals JOIN grp USING (pat) JOIN sz USING (grp) WHERE val IS NOT NULL GROUP BY 1, 2, 3""")
def c10(spark, d):
    tl = timeline(spark, d)
    groups = tl.select("pat").distinct().withColumn("grp", F.col("pat") % 2 == 0)
    return cl.group_hist(cl.value_at(tl.filter("kind = 'click'"), _GRID), groups, 15, 0.0, 150.0).withColumn("share", F.round("share", 9))


@query("c11_usable", _at(_GRID, "kind = 'click'") + " SELECT pat, count(*) - count(val) AS n_missing FROM vals GROUP BY 1 HAVING count(*) - count(val) <= 4")
def c11(spark, d):
    return cl.usable(cl.value_at(timeline(spark, d).filter("kind = 'click'"), _GRID))


@query("w1_w2_trend", _TL + """, l AS (SELECT pat, kind, week, val - lag(val) OVER w AS change, week - lag(week) OVER w AS gap FROM tl WINDOW w AS (PARTITION BY pat, kind ORDER BY week))
  SELECT pat, kind, week, round(change, 6) AS change, round(change / gap, 6) AS slope FROM l""")
def w1(spark, d):
    t = cl.trend(avg_duplicates(timeline(spark, d), ["pat", "kind"]))
    return t.select("pat", "kind", "week", F.round("change", 6).alias("change"), F.round("slope", 6).alias("slope"))


@query("w5_running_sum", "WITH " + TIMELINE_SQL + """, p AS (SELECT pat, week, count(*) AS n FROM timeline GROUP BY 1, 2) SELECT pat, week, CAST(sum(n) OVER (PARTITION BY pat ORDER BY week) AS BIGINT) AS total FROM p""")
def w5(spark, d):
    from strandframe.operators.ordered import ordered_scan
    per = timeline(spark, d).groupBy("pat", "week").agg(F.count("*").alias("n"))
    return ordered_scan(per, ["pat"], "week", [("total", "sum", F.col("n"))], 64).select("pat", "week", "total")


@query("w8_top_row", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn DESC, role DESC) AS r FROM conversations) WHERE r = 1")
def w8(spark, d):
    from strandframe.operators.ordered import best_row
    return best_row(table(spark, d, "conversations"), ["conv_id"], F.length("text"), ["turn", "role"])


@query("w9_last_value", "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations GROUP BY 1")
def w9(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("w10_row_pairs", "SELECT conv_id, turn, next_turn FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) WHERE next_turn IS NOT NULL")
def w10(spark, d):
    from strandframe.operators.ordered import ordered_scan
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    return ordered_scan(turns, ["conv_id"], "turn", [("next_turn", "next_after", F.col("turn"))], 1000).filter("next_turn IS NOT NULL")


@query("w14_percentiles", "SELECT l_returnflag AS grp, quantile_cont(l_extendedprice, 0.05) AS p05, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1")
def w14(spark, d):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(q.alias("q"))
    return out.select("grp", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))])
