"""Hand-computed cases for rules that are easy to get almost right."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import scalars as sc
from strandframe.functions.special import hyper_sf
from strandframe.operators import aggregates as agg, bins as bn, clinical as cl, expression as ex, mixture as mx, motifs as mt, network as nw, pileup as pu


def columns(spark, rows):
    """(seq_id, text, reference) laid column by column."""
    return spark.createDataFrame([(i, p, b, r, b == r) for i, t, ref in rows for p, (b, r) in enumerate(zip(t, ref))],
                                 "seq_id int, ref_pos int, base string, ref_base string, is_match boolean")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(120)], "a int, b int")
    assert {r["component"] for r in nw.components(edges).collect()} == {0}


def test_snp_sites_add_both_directions(spark):
    ref = "A" * 41
    two = ref[:20] + "A" + ref[21:]  # column 20 lies in a run of 41: 21 forward, 21 backward
    runs = pu.run_lengths(columns(spark, [(1, two, ref), (2, two, ref), (3, ref[:20] + "C" + ref[21:], ref)]))
    assert [r["ref_pos"] for r in pu.snp_sites(runs, min_run=30).collect()] == [20]
    assert pu.snp_sites(runs, min_run=42).count() == 0


def test_island_shares_count_all_sequences(spark):
    ref = "ACGT" * 5
    runs = pu.run_lengths(columns(spark, [(0, ref, ref)] + [(k, ref[:5], ref) for k in range(1, 10)])).withColumn("ref_id", F.lit("r"))
    found = pu.islands(runs, 4, 0.5)
    assert [(r["start"], r["end"]) for r in found.collect()] == [(0, 5)]
    profile = {r["ref_pos"]: r["homology"] for r in pu.homology_profile(runs, every=1).collect()}
    assert profile[4] == 1.0 and profile[5] == 0.1


def test_pileup_keeps_what_lies_past_the_reference(spark):
    s = spark.createDataFrame([(1, "AC"), (2, "ACGG")], "seq_id int, seq string")
    got = {(r["seq_id"], r["ref_pos"]): (r["base"], r["ref_base"], r["is_match"]) for r in pu.trivial_pileup(s).collect()}
    assert got[2, 3] == ("G", "-", False) and len(got) == 6


def test_forced_edges_are_returned(spark):
    hits = spark.createDataFrame([("m", k, k * 9) for k in range(10)], "motif string, seq_id int, start int")
    best = bn.optimise_bins(hits, 10, 100, forced=[33], max_rounds=2).first()
    assert 33 in best["edges"]


def test_kmeans_bins_settle(spark):
    hits = spark.createDataFrame([("m", s, x) for s in range(4) for x in (10 + s, 50 + s, 90 + s)], "motif string, seq_id int, start int")
    got = [(r["lo"], r["hi"]) for r in bn.kmeans_bins(hits, 4, k=3).orderBy("lo").collect()]
    assert got == [(10, 32), (32, 72), (72, 94)]


def test_kmeans_borders_are_never_beaten():
    draw = random.Random(5)
    for _ in range(150):
        x = np.array(sorted(draw.sample(range(60), draw.randint(1, 9))), float)
        n = np.array([draw.randint(1, 6) for _ in x], float)

        def cost(cuts):
            parts = zip([0, *cuts], [*cuts, len(x)])
            return sum((n[a:b] * (x[a:b] - np.average(x[a:b], weights=n[a:b])) ** 2).sum() for a, b in parts)

        for k in range(1, len(x) + 1):
            got = bn.kmeans_borders(x, n, k)
            assert len(got) == k - 1 and got == sorted(set(got)) and all(0 < c < len(x) for c in got)
            assert cost(got) <= min(cost(c) for c in itertools.combinations(range(1, len(x)), k - 1)) + 1e-9


def test_kmeans_bins_cover_all_positions(spark):
    hits = spark.createDataFrame([("a", s, p) for s in range(6) for p in (5, 6, 100 + s, 900)] + [("a", 1, None), ("rare", 1, 3), (None, 1, 3)],
                                 "motif string, seq_id int, start int")
    got = bn.kmeans_bins(hits, 20, k=3).orderBy("lo").collect()
    assert [(r["motif"], r["lo"], r["hi"]) for r in got] == [("a", 5, 54), ("a", 54, 502), ("a", 502, 901)]
    few = bn.kmeans_bins(hits.filter("start < 7"), 20, k=9).orderBy("lo").collect()
    assert [(r["lo"], r["hi"]) for r in few] == [(5, 6), (6, 7)]
    assert bn.kmeans_bins(hits.limit(0), 20, k=3).isEmpty()



def test_clean_term(spark):
    texts = [" apoptosis, cell death ,", "binding~ GO", "hsa04110 Cell cycle; hsa04110", "", "O"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r["c"] for r in df.select("k", sc.clean_term("t").alias("c")).orderBy("k").collect()]
    assert got == ["apoptosis, cell death ", "binding", "hsa04110 Cell cycle", "", ""]


def test_common_times_start_at_zero(spark):
    tl = spark.createDataFrame([(w,) for w in (-4, -4, -4, 0, 8, 8, 2)], "week int")
    assert sorted(r["week"] for r in agg.common_times(tl, 3).collect()) == [0, 2, 8]


def test_gene_set_sizes_are_strict(spark):
    sets = spark.createDataFrame([(f"s{n}", f"g{k}") for n in (5, 6, 8) for k in range(n)], "set_name string, gene string")
    genes = sets.select("gene").distinct()
    assert {r["set_name"] for r in ex.sized_sets(sets, genes, 5, 8).collect()} == {"s6"}


def test_spline_is_a_cubic_through_a_cubic():
    x = np.array([0.0, 1, 3, 4, 7])
    at = np.array([0.5, 2, 6.5])
    cubic = lambda v: v**3 - 2 * v**2 + 3
    assert cl.spline_through(x, cubic(x), at) == pytest.approx(cubic(at))
    assert cl.spline_through(x[:3], x[:3] ** 2, at[:2]) == pytest.approx(at[:2] ** 2)
    assert np.isnan(cl.spline_through(x[:2], x[:2], at)).all()


def test_hypergeometric_tail_of_large_lists(spark):
    row = spark.range(1).select(
        hyper_sf(F.lit(500_001_000).cast("long"), F.lit(10**10).cast("long"), F.lit(5 * 10**9).cast("long"), F.lit(10**9).cast("long")).alias("p"),
        hyper_sf(F.lit(500_010_000).cast("long"), F.lit(10**12).cast("long"), F.lit(5 * 10**11).cast("long"), F.lit(10**9).cast("long")).alias("q")).first()
    sd = math.sqrt(10**9 * 0.25 * 0.9)
    normal = 0.5 * math.erfc((1000 - 0.5) / sd / math.sqrt(2))
    assert row["p"] == pytest.approx(normal, rel=1e-5)
    assert row["q"] == pytest.approx(0.5 * math.erfc((10_000 - 0.5) / math.sqrt(10**9 * 0.25 * 0.999) / math.sqrt(2)), rel=1e-4)


def test_threshold_is_where_the_densities_cross(spark):
    g = spark.createDataFrame([("a", 0.3, 0.7, 0.0, 4.0, 1.0, 1.5), ("same", 0.5, 0.5, 0.0, 2.0, 1.0, 1.0), ("none", 0.999, 0.001, 0.0, 0.5, 1.0, 1.0)],
                              "gene string, w1 double, w2 double, m1 double, m2 double, s1 double, s2 double")
    got = {r["gene"]: r for r in mx.gmm_threshold(g).collect()}
    pdf = lambda x, w, m, s: w * math.exp(-0.5 * ((x - m) / s) ** 2) / s
    x = got["a"]["threshold"]
    assert 0 < x < 4 and pdf(x, 0.3, 0.0, 1.0) == pytest.approx(pdf(x, 0.7, 4.0, 1.5))
    assert got["a"]["area1"] == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)))
    assert got["a"]["area2"] == pytest.approx(0.5 * math.erfc((4 - x) / 1.5 / math.sqrt(2)))
    assert got["same"]["threshold"] == pytest.approx(1.0) and got["none"]["threshold"] is None


def test_motif_array_has_zero_rows(spark):
    s = spark.createDataFrame([(1, "xaax"), (2, "zzzz")], "seq_id int, seq string")
    hits = mt.scan_motifs(s, [("a", "a"), ("q", "q")])
    got = {(r["seq_id"], r["motif"]): list(r["presence"]) for r in mt.motif_array(hits, 0, 3, s, ["a", "q"]).collect()}
    assert got == {(1, "a"): [0, 1, 1, 0], (1, "q"): [0] * 4, (2, "a"): [0] * 4, (2, "q"): [0] * 4}


def test_site_calls_have_ends(spark):
    s = spark.createDataFrame([(1, "xxABCxx"), (2, "xADCx")], "seq_id int, seq string")
    got = {r["seq_id"]: (r["start"], r["end"], r["is_wild"]) for r in mt.call_sites(s, [("r", "[A][B][C]", "[A][D][C]")]).collect()}
    assert got == {1: (2, 5, True), 2: (1, 4, False)}


def test_scanners_are_linear_in_hits(spark):
    def seconds(n):
        df = spark.createDataFrame([("ab" * n,)], "t string").select(
            F.size(sc.plain_hits("t", "a.")).alias("plain"), F.size(sc.overlap_hits("t", "a.*?b")).alias("over"))
        start = time.perf_counter()
        row = df.first()
        assert (row["plain"], row["over"]) == (n, n)
        return time.perf_counter() - start
    seconds(1000)
    assert seconds(40_000) < 5


def test_markup_of_many_intervals(spark):
    n = 20_000
    df = spark.createDataFrame([("abc" * n,)], "t string").withColumn(
        "iv", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((k * 3).alias("start"), (k * 3 + 1).alias("end"))))
    start = time.perf_counter()
    row = df.select(sc.markup("t", "iv", "<", ">").alias("m"), sc.mask_vector(F.length("t"), "iv").alias("v")).first()
    assert row["m"] == "<a>bc" * n and row["v"] == "100" * n
    assert time.perf_counter() - start < 60  # a list copied per interval took minutes
