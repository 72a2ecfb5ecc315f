"""Steps whose cost must not grow faster than their input, against plain counts."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from strandframe.functions import scalars as sc
from strandframe.operators import aggregates as agg, bins as bn, mixture as mx, motifs as mt, pwm as pw
from strandframe.sources import tables


def test_bins_are_counted_per_distinct_bin(spark):
    r = random.Random(3)
    hits = [(m, s, r.randrange(300)) for m in "ab" for s in [None, 1, 2, 3, 4] for _ in range(r.randrange(25))] + [("a", 1, None)]
    cuts = {"a": [0, 3, 4, 100, 280], "b": [5, 5, 60, 299]}
    more = [(m, lo, hi) for m in "ab" for lo in (0, 7, 64, 200) for hi in (64, 65, 250, 7)]
    bins = [(m, lo, hi) for m, e in cuts.items() for lo, hi in zip(e, e[1:])] + more + more
    spots = bn._spots(spark.createDataFrame(hits + hits, "motif string, seq_id int, start int"))
    got = {tuple(x)[:3]: tuple(x)[3:] for x in bn.occupancy(spots, spark.createDataFrame(bins, "motif string, lo int, hi int")).collect()}

    def plain(m, lo, hi):
        per = {}
        for motif, s, x in set(hits):
            if motif == m and x is not None and lo <= x < hi:
                per[s] = per.get(s, 0) + 1
        return sum(n == 1 for n in per.values()), sum(n > 1 for n in per.values())

    assert got == {b: plain(*b) for b in bins if any(plain(*b))}


SEQS = [(1, "xx" * 1500 + "endhenthe"), (2, "then the end"), (3, ""), (4, None), (5, "en"), (1, "ent")]


@pytest.fixture(scope="module")
def scanned(spark):
    return spark.createDataFrame(SEQS, "seq_id int, seq string"), pw.pwm_from_regex(spark, [("en_dt", "en[dt]"), ("the", "the")], "adehntx")


def test_null_scores_may_come_counted(spark):
    null = spark.createDataFrame([("p", 1.0, 3), ("p", 2.0, 1), ("q", 1.0, 2)], "pwm_id string, score double, n long")
    asked = spark.createDataFrame([("p", 0.5), ("p", 1.0), ("p", 2.0), ("q", 0.0), ("q", 9.0)], "pwm_id string, score double")
    got = {(r.pwm_id, r.score): r.p for r in pw.empirical_p(asked, null, times="n").collect()}
    assert got == {("p", 0.5): 1.0, ("p", 1.0): 0.25, ("p", 2.0): 0.25, ("q", 0.0): 1.0, ("q", 9.0): 0.5}


def test_objective_does_not_shuffle_placements(spark, scanned):
    s, m = scanned
    hits = spark.createDataFrame([(1, "en_dt", 3000), (1, "en_dt", 3000), (2, "en_dt", 9), (2, "other", 0), (None, "en_dt", 0)], "seq_id int, motif string, start int")
    marked = pw.pwm_scan(s, m, 0.0, hits=hits)
    on = {(r.seq_id, r.start, r.score) for r in marked.filter("hit").collect()}
    assert on == {(1, 3000, 2.5), (2, 9, 2.5)}
    got = {r.pwm_id: r.ratio for r in pw.pwm_objective(marked).collect()}
    off = [r.score for r in marked.filter("pwm_id = 'en_dt' AND NOT hit").collect()]
    assert got["the"] is None and got["en_dt"] == pytest.approx(sum(off) / len(off) / 2.5)
    assert not re.search(r"hashpartitioning\([^)]*pwm_id[^)]*start", marked._jdf.queryExecution().executedPlan().toString())


def test_equal_texts_are_counted_together(spark):
    rows = [("p", "ab")] * 3 + [("p", "b"), ("p", None), ("q", "")]
    got = {tuple(r)[:3]: r.weight for r in pw.pwm_from_seqs(spark.createDataFrame(rows, "pwm_id string, seq string")).collect() if r.symbol}
    assert got == {("p", 0, "a"): 0.6, ("p", 0, "b"): 0.2, ("p", 1, "b"): 0.6}


def test_wide_expression_matrix(spark, tmp_path):
    (tmp_path / "m").write_text("id\t" + "\t".join(f"s{i}x" for i in range(3000)) + "\ng\t" + "\t".join(str(i) for i in range(3000)) + "\n")
    (tmp_path / "c").write_text("s1 D1\ns12 D2\ns2 7\n")
    out = tables.read_expression(spark, str(tmp_path / "m"), str(tmp_path / "c"), "d")
    got = {r["sample"]: (r.value, r.cls) for r in out.collect()}
    want = {f"s{i}x": (float(i), 2 if str(i).startswith("12") else 1 if str(i)[0] == "1" else 7) for i in range(3000) if str(i)[0] in "12"}
    assert got == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_best_placement_is_condensed_without_a_sort_of_all(spark):
    rows = [(1, "p", 0, 1.0), (1, "p", 4, 2.5), (1, "p", 2, 2.5), (1, "q", 3, None), (2, "p", 9, -1.0), (None, "p", 1, 0.5)]
    best = pw.pwm_best(spark.createDataFrame(rows, "seq_id int, pwm_id string, start int, score double"), ["seq_id"])
    assert re.search(r"HashAggregate\(keys=\[[^\]]*score", best._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in best.collect()} == {(1, "p", 2.5, 2), (1, "q", None, None), (2, "p", -1.0, 9), (None, "p", 0.5, 1)}


def test_counts_in_a_range_read_the_range(spark, monkeypatch):
    texts = ["aabaab" * 5, "b", "", None, "x" * 8 + "aab", "aa"]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string")
    for lo, hi in ((0, 2), (3, 9), (8, 8), (5, 4), (None, 3), (2, None)):
        got = mt.motif_count(seqs, [("aab", "a+b"), ("a[ab]", "a[ab]")], lo, hi)
        want = {(i, n): None if t is None else sum((lo or 0) <= m.start() <= (10**6 if hi is None else hi) for m in re.finditer(f"(?={r})", t))
                for i, t in enumerate(texts) for n, r in (("aab", "a+b"), ("a[ab]", "a[ab]"))}
        assert {(r["seq_id"], r["motif"]): r["n_hits"] for r in got.collect()} == want
    monkeypatch.setattr(mt, "overlap_hits", None)  # a bounded pattern needs no list of all hits
    assert mt.motif_count(seqs, [("a[ab]", "a[ab]")], 3, 9).count() == len(texts)


def test_hits_for_clustered_bins_are_found_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(bn, "cut_lineage", lambda df, real=bn.cut_lineage: kept.append(df.columns) or real(df))
    hits = spark.createDataFrame([("a", s, x) for s in range(4) for x in (1, 2, 50, 51)] + [("a", 1, None)], "motif string, seq_id int, start int")
    bins = {(r["motif"], r["bin_id"]): (r["lo"], r["hi"]) for r in bn.kmeans_bins(hits, 4, k=2).collect()}
    assert kept[0] == ["motif", "seq_id", "start"]
    assert set(bins) == {("a", 0), ("a", 1)} and bins["a", 0][0] <= 1 and bins["a", 1][1] >= 51


def test_prediction_sets_read_their_input_twice_at_most(spark):
    rows = [("v", "m", "s1", "p1"), ("v", "n", "s1", "p1"), ("v", "n", "p1", "s1"), ("w", "m", "s1", "p2"), ("w", "m", "s1", "p2"), ("w", None, "s2", None)]
    out = agg.prediction_sets(spark.createDataFrame(rows, "virus string, motif string, h1 string, h2 string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 2
    want = {}
    for v, m, a, b in rows:
        for grain in ((v, m), (v, "all"), ("all", "all")):
            for role, member in (("H1", a), ("H2", b), ("H12", a), ("H12", b), ("H1toH2", ">".join(x for x in (a, b) if x))):
                want.setdefault((*grain, role), set()).add(member)
    assert {tuple(r)[:3]: r["n"] for r in out.collect()} == {k: len(v) for k, v in want.items()}


def test_a_round_of_a_mixture_holds_a_slice_at_a_time():
    x = np.random.default_rng(2).normal(size=200_001)
    theta = np.array([0.3, -1.0, 0.7, 0.8, 1.2])
    tracemalloc.start()
    got = mx._em_sums(x, theta)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes
    l1, l2 = (np.log(w) - np.log(s) - 0.5 * ((x - m) / s) ** 2 for w, m, s in ((0.3, -1.0, 0.8), (0.7, 0.7, 1.2)))
    r, d = 1 / (1 + np.exp(l2 - l1)), x + 0.15
    want = [len(x), r.sum(), (r * d).sum(), (r * d * d).sum(), d.sum(), (d * d).sum(), np.logaddexp(l1, l2).sum() - len(x) * 0.5 * np.log(2 * np.pi)]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_hits_are_read_off_a_text_that_is_searched_once(spark):
    texts = [None, "", "a", "x" * 255 + "ana" + "n" * 254 + "ana", "\U0001F600ana" * 90, "ban" * 200, "a" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in ("an", "a+", "(n)(a)?", "x|$"):
        got = {r["i"]: r for r in df.select("i", sc.plain_hits("t", pattern).alias("p"), sc.mark_places(sc.start_marks("t", pattern)).alias("m")).collect()}
        for i, t in enumerate(texts):
            assert got[i]["p"] == (None if t is None else [(m.start(), m.group()) for m in re.finditer(pattern, t)])
            assert got[i]["m"] == (None if t is None else [k for k in range(len(t)) if re.match(pattern, t[k:])])
    for finder, times in ((sc.plain_hits, 1), (sc.overlap_hits, 2)):  # the second reads where overlapping matches start
        plan = df.select(finder("t", "an").alias("h"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_replace(") == times and "split(t" not in plan
