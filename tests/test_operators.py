"""Operators against brute force on small data, known values and invariants."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import scalars as sc
from strandframe.operators import aggregates as agg, alignment as al, bins as bn, clinical as cl, columns as co, enrichment as en, expression as ex, features as ft
from strandframe.operators import joins, mixture as mx, models as ml, motifs as mt, network, partitions as pt, pileup as pu, pwm as pw
from strandframe.operators.ordered import exact_ranks, ordered_scan
from strandframe.operators.sampling import hash_draw, permute_labels
from strandframe.sources import sinks

RNG = random.Random(7)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def overlapping(text, pattern):
    p, out, at = re.compile(pattern), [], 0
    while (m := p.search(text, at)) is not None:
        out.append((m.start(), m.end(), m.group()))
        at = m.start() + 1
    return out


def test_scan_overlapping_long_and_short(spark):
    texts = ["", "aaaa", "abab\nabab", "".join(RNG.choice("abc\n") for _ in range(6000)), "é" * 10 + "aba" * 1500]
    patterns = [("aa", "aa"), ("aba", "aba"), ("a.b", "a.b"), ("cls", "[ab]{2,3}c?"), ("end", "a$"), ("many", "b+c")]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string")
    expected = sorted((i, n, *h) for i, t in enumerate(texts) for n, p in patterns for h in overlapping(t, p))
    assert rows(mt.scan_motifs(seqs, patterns), "seq_id", "motif", "start", "end", "match") == expected
    assert rows(mt.scan_motifs(seqs.repartition(5), patterns), "seq_id", "motif", "start", "end", "match") == expected
    plain = sorted((i, n, m.start(), m.end(), m.group()) for i, t in enumerate(texts) for n, p in patterns for m in re.finditer(p, t))
    assert rows(mt.scan_motifs(seqs, patterns, overlap=False), "seq_id", "motif", "start", "end", "match") == plain


def test_motif_count_known_values(spark):
    seqs = spark.createDataFrame([(1, "AAAAAAAATAAA")], "seq_id int, seq string")
    for (lo, hi), n in {(None, None): 1, (0, 6): 0, (6, 20): 1}.items():
        assert mt.motif_count(seqs, [("T", "T")], lo, hi).first()["n_hits"] == n


def test_run_lengths_known_values(spark):
    match = [1, 1, 1, 0, 0, 0, 1, 0, 1, 0, 1, 1]
    pile = spark.createDataFrame([(1, i, bool(m)) for i, m in enumerate(match)], "seq_id int, ref_pos int, is_match boolean")
    for span in (3, 4096):
        got = rows(pu.run_lengths(pile, span=span), "ref_pos", "forward", "backward")
        assert [g[1] for g in got] == [3, 2, 1, 0, 0, 0, 1, 0, 1, 0, 2, 1]
        assert [g[2] for g in got] == [1, 2, 3, 0, 0, 0, 1, 0, 1, 0, 1, 2]


def test_ordered_scan_chunks_agree(spark):
    data = [(k, t, RNG.choice([None, RNG.randint(-9, 9)])) for k in "ab" for t in RNG.sample(range(200), 90)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    specs = [(n, n, F.col("v")) for n in ("last", "last_before", "next", "next_after", "sum", "max", "max_before")]
    cols = ["k", "t", *[s[0] for s in specs]]
    whole = [tuple(0 if c == "sum" and x is None else x for c, x in zip(cols, r)) for r in ordered_scan(df, ["k"], "t", specs).select(*cols).orderBy("k", "t").collect()]
    for span in (7, 50, 1000):
        assert [tuple(r) for r in ordered_scan(df, ["k"], "t", specs, span).select(*cols).orderBy("k", "t").collect()] == whole


def test_sliding_similarity_over_block_borders(spark):
    values = [RNG.random() for _ in range(300)]
    prof = spark.createDataFrame(list(enumerate(values)), "ref_pos int, homology double")
    got = rows(pu.sliding_similarity(prof, 26, span=40), "ref_pos", "similarity")
    assert [g[1] for g in got] == pytest.approx([np.mean(values[i:i + 26]) for i in range(300)])


def test_merge_intervals(spark):
    spans = [(RNG.choice("xy"), s, s + RNG.randint(1, 9)) for s in RNG.choices(range(400), k=60)]
    df = spark.createDataFrame(spans, "ref string, start int, end int")
    expected = []
    for ref in "xy":
        for s, e in sorted((s, e) for r, s, e in spans if r == ref):
            if expected and expected[-1][0] == ref and s <= expected[-1][2]:
                expected[-1][2] = max(expected[-1][2], e)
            else:
                expected.append([ref, s, e])
    merged = ft.merge_intervals(df, ["ref"], span=16)
    assert rows(merged, "ref", "start", "end") == sorted(map(tuple, expected))
    assert rows(ft.merge_intervals(merged, ["ref"]), "ref", "start", "end") == sorted(map(tuple, expected))


def test_islands_left_to_right(spark):
    runs = []
    for s in range(4):
        m = [RNG.random() < 0.8 for _ in range(120)]
        for i in range(120):
            n = next((j for j in range(i, 120) if not m[j]), 120) - i
            runs.append(("r", s, i, n))
    df = spark.createDataFrame(runs, "ref_id string, seq_id int, ref_pos int, forward int")
    expected, pos = [], 0
    while pos < 120:
        at = sorted((n for _, _, i, n in runs if i == pos), reverse=True)
        best = max((n for k, n in enumerate(at) if (k + 1) / 4 >= 0.5 and n >= 3), default=0)
        if best:
            expected.append((pos, pos + best))
        pos += max(best, 1)
    assert rows(pu.islands(df, 3, 0.5), "start", "end") == expected


def test_shared_counts_with_popular_items(spark):
    sets = [(s, i) for s in range(90) for i in RNG.sample(range(40), 6)] + [(s, 99) for s in range(90)]
    df = spark.createDataFrame(sets, "set_id int, item int")
    by = {s: {i for t, i in sets if t == s} for s in range(90)}
    expected = sorted((a, b, len(by[a] & by[b])) for a, b in itertools.combinations(range(90), 2) if by[a] & by[b])
    for cap in (3, 64, 1000):
        assert rows(joins.shared_counts(df, cap=cap), "i", "j", "shared") == expected
    grid = rows(joins.all_pairs(df.filter("item <> 99")), "i", "j", "shared")
    assert len(grid) == 90 * 89 // 2 and min(g[2] for g in grid) == -1


def test_pair_all_small_and_large(spark, monkeypatch):
    words, texts = spark.range(30).select(F.col("id").alias("w")), spark.range(50).select(F.col("id").alias("t"))
    small = rows(joins.pair_all(words, texts), "w", "t")
    monkeypatch.setattr(joins, "DICTIONARY_ROWS", 5)
    assert rows(joins.pair_all(words, texts), "w", "t") == small and len(small) == 1500


def test_nearest_join(spark):
    a = [(i, RNG.choice("pq"), RNG.randint(0, 500)) for i in range(80)]
    b = [(RNG.choice("pq"), RNG.randint(0, 500)) for _ in range(30)]
    got = rows(joins.nearest_join(spark.createDataFrame(a, "id int, chrom string, pos int"), spark.createDataFrame(b, "chrom string, site int"), ["chrom"], 20, span=16), "id", "site")
    expected = []
    for i, c, p in a:
        near = sorted((abs(s - p), s) for d, s in b if d == c and abs(s - p) <= 20)
        if near:
            expected.append((i, near[0][1]))
    assert got == sorted(expected)


def test_greedy_match_equals_sequential(spark):
    pairs = [("g", l, r, RNG.randint(0, 20)) for l in range(12) for r in range(12) if RNG.random() < 0.5]
    got = rows(ft.greedy_match(spark.createDataFrame(pairs, "s string, l int, r int, c int"), ["s"], "l", "r", "c"), "l", "r", "c")
    left, right, expected = set(), set(), []
    for _, l, r, c in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if l not in left and r not in right:
            expected.append((l, r, c))
            left.add(l), right.add(r)
    assert got == sorted(expected)


def test_alignment_against_plain_programming(spark):
    def score(a, b):
        f = np.zeros((len(a) + 1, len(b) + 1), int)
        f[0], f[:, 0] = np.arange(len(b) + 1) * al.GAP, np.arange(len(a) + 1) * al.GAP
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            f[i, j] = max(f[i - 1, j - 1] + (al.MATCH if a[i - 1] == b[j - 1] else al.MISMATCH), f[i - 1, j] + al.GAP, f[i, j - 1] + al.GAP)
        return f[-1, -1]

    for _ in range(20):
        a, b = ("".join(RNG.choice("ACGT") for _ in range(RNG.randint(0, 25))) for _ in range(2))
        x, y, s = al.align_pair(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
        assert s == score(a, b) == sum(al.GAP if "-" in (p, q) else al.MATCH if p == q else al.MISMATCH for p, q in zip(x, y))
    seqs = spark.createDataFrame([(1, "ACGT"), (2, "ACGT"), (3, "AGT")], "seq_id int, seq string")
    refs = spark.createDataFrame([("r", "ACGT")], "ref_id string, seq string")
    pile = al.to_pileup(al.align_to_refs(seqs, refs), seqs)
    assert rows(pile.groupBy("seq_id").agg(F.sum(F.col("is_match").cast("int")).alias("n"))) == [(1, 4), (2, 4), (3, 3)]


def test_alignment_in_blocks_gives_the_same_path(monkeypatch):
    texts = [tuple("".join(RNG.choice("ACG") for _ in range(RNG.randint(0, 40))) for _ in range(2)) for _ in range(60)]
    whole = [al.align_pair(a, b) for a, b in texts]
    for cells in (1, 9, 100):
        monkeypatch.setattr(al, "CELLS", cells)
        monkeypatch.setattr(al, "PARTS", 3)
        assert [al.align_pair(a, b) for a, b in texts] == whole


def test_alignment_of_long_texts_needs_little_memory():
    a = "".join(RNG.choice("ACGT") for _ in range(12000))
    b = a[:5000] + a[5200:]
    tracemalloc.start()
    x, y, s = al.align_pair(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s == al.MATCH * len(b) + al.GAP * 200 and x == a and y.replace("-", "") == b
    assert peak < 90_000_000  # the whole table has 141,600,000 steps


def test_reuse_aligns_missing_pairs_only(spark):
    seqs = spark.createDataFrame([(1, "ACGT"), (2, "ACGT"), (3, "AGT"), (4, None), (5, "")], "seq_id int, seq string")
    refs = spark.createDataFrame([("r", "ACGT"), ("q", "AAGT"), ("none", None)], "ref_id string, seq string")
    every = al.align_to_refs(seqs, refs)
    assert every.count() == 6
    one = every.filter("ref_id = 'r'").withColumn("score", F.lit(99).cast("long"))
    other = spark.createDataFrame([("0", "r", "A", "A", 7)], one.schema)
    got = al.reuse_alignments(seqs, refs, one.union(one).union(other))
    assert rows(got, "digest", "ref_id") == rows(every, "digest", "ref_id")
    assert {(r["ref_id"], r["score"] == 99) for r in got.collect()} == {("r", True), ("q", False)}


@pytest.fixture()
def small_pieces(monkeypatch):
    monkeypatch.setattr(co, "SPAN", 5)


def test_packed_columns_equal_letters(spark, small_pieces):
    texts = [(i, "".join(RNG.choice("ACG") for _ in range(RNG.randint(0, 34)))) for i in range(12)] + [(90, None), (91, "CC" * 12), (92, "--ACGAC--")]
    refs = [("r", "C" * 20), ("q", "ACG" * 8)]
    packed = co.pack_sequences(spark.createDataFrame(texts, "seq_id int, seq string"), spark.createDataFrame(refs, "ref_id string, seq string"))
    bounds, letters = co.fragments(packed), {}
    for (r, ref), (s, t) in itertools.product(refs, texts):
        letters[r, s] = [(b, ref[p] if p < len(ref) else "-") for p, b in enumerate(t or "")]

    def runs_of(cells, lo=0):
        out, start = [], None
        for p, (b, r) in enumerate([*cells, ("x", "y")]):
            if b == r and start is None:
                start = p
            elif b != r and start is not None:
                out.append((lo + start, lo + p))
                start = None
        return out

    want = sorted((r, s, *x) for (r, s), c in letters.items() for x in runs_of(c))
    assert rows(co.match_runs(packed), "ref_id", "seq_id", "start", "end") == want
    ends = {}
    for key, cells in letters.items():
        mine = [p for p, (b, _) in enumerate(cells) if b.isalpha()]
        if mine:
            ends[key] = (mine[0], mine[-1])
    assert rows(bounds, "ref_id", "seq_id", "first_pos", "last_pos") == sorted((*k, *v) for k, v in ends.items())
    summary = {(r["ref_id"], r["seq_id"]): (r["n"], r["longest"], r["total"]) for r in co.run_summary(packed).collect()}
    for key, cells in letters.items():
        if cells:
            sizes = [e - s for s, e in runs_of(cells)]
            assert summary[key] == (len(cells), max(sizes, default=0), sum(n * (n + 1) // 2 for n in sizes))

    inner = co.match_runs(packed, bounds)
    assert rows(inner, "ref_id", "seq_id", "start", "end") == sorted((*k, *x) for k, (lo, hi) in ends.items() for x in runs_of(letters[k][lo:hi + 1], lo))
    cover = {}
    for (r, s), (lo, hi) in ends.items():
        spans = runs_of(letters[r, s][lo:hi + 1], lo)
        for p in range(lo, hi + 1):
            size = next((e - b for b, e in spans if b <= p < e), 0)
            cover.setdefault((r, p), []).append(size)
    expected = {k: (sum(v > 0 and v + 1 > 2 for v in vs) / len(vs), sum(v == 0 for v in vs) / len(vs)) for k, vs in cover.items()}
    sites = co.snp_sites(inner, bounds, 2)
    got = {(r["ref_id"], r["ref_pos"]): (r["run_share"], r["mismatch_share"]) for r in sites.collect()}
    assert got == {k: (pytest.approx(a), pytest.approx(b)) for k, (a, b) in expected.items() if a > 0.05 and b > 0.05}
    calls = sorted((r, s, p, letters[r, s][p][0] if ends.get((r, s)) and ends[r, s][0] <= p <= ends[r, s][1] else None)
                   for (r, p) in got for s, t in texts if p < len(t or ""))
    assert sorted(map(str, rows(co.base_calls(packed, sites, bounds), "ref_id", "seq_id", "ref_pos", "base"))) == sorted(map(str, calls))
    genes = spark.createDataFrame([("g", 1, 15), ("h", 7, 300), ("none", 4, 4)], "gene string, start int, end int")
    changed = []
    for (r, s), (lo, hi) in ends.items():
        for g, a, e in (("g", 1, 15), ("h", 7, 300)):
            for c in range(a, e - 2, 3):
                if lo <= c and c + 2 <= hi and letters[r, s][c:c + 3] and any(b != x for b, x in letters[r, s][c:c + 3]):
                    changed.append((r, s, g, (c - a) // 3, "".join(b for b, _ in letters[r, s][c:c + 3])))
    assert rows(co.classify_mutations(packed, genes, bounds), "ref_id", "seq_id", "gene", "codon", "codon_seq") == sorted(changed)


def test_packed_alignments_keep_reference_columns(spark, small_pieces):
    seqs = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACGTTTACGTAC"), (3, "ACACGTAC"), (4, "")], "seq_id int, seq string")
    refs = spark.createDataFrame([("r", "ACGTACGTAC"), ("empty", "")], "ref_id string, seq string")
    aligned = al.align_to_refs(seqs, refs)
    packed = co.pack_alignments(aligned, seqs)
    want = rows(al.to_pileup(aligned, seqs), "ref_id", "seq_id", "ref_pos", "base")
    got = [(r["ref_id"], r["seq_id"], r["first"] + i, b) for r in packed.collect() for i, b in enumerate(r["base"][:5])]
    assert sorted(got) == want and all(len(r["base"]) == len(r["ref_base"]) <= 7 for r in packed.collect())


def test_classify_mutations(spark):
    ref, seq = "ATGAAATTTTGG", "ATGAAGTATTGA"
    pile = spark.createDataFrame([(1, i, s, r, s == r) for i, (s, r) in enumerate(zip(seq, ref))], "seq_id int, ref_pos int, base string, ref_base string, is_match boolean")
    genes = spark.createDataFrame([("g", 0, 12)], "gene string, start int, end int")
    assert rows(pu.classify_mutations(pile, genes), "codon", "mutation_class") == [(1, 0), (2, 1), (3, 2)]


def test_hash_draw_sizes_and_rerun(spark):
    pool = spark.range(997).select(F.col("id").alias("item"), (F.col("id") % 3).alias("cls"))
    drawn = hash_draw(pool, "item", 5, 100)
    counts = drawn.groupBy("rep").agg(F.count("*").alias("n"), F.countDistinct("item").alias("d")).collect()
    assert len(counts) == 5 and all(r["n"] == r["d"] == 100 for r in counts)
    assert rows(drawn, "rep", "item") == rows(hash_draw(pool.repartition(7), "item", 5, 100), "rep", "item")
    strata = hash_draw(pool, "item", 2, 2 / 3, ["cls"]).groupBy("cls", "rep").count().collect()
    assert {r["count"] for r in strata} == {222, 221}
    assert hash_draw(pool, "item", 1, 5000).count() == 997
    flip = permute_labels(pool, "item", 2)
    assert flip.groupBy("rep").agg(F.countDistinct("relabelled").alias("d")).filter("d <> 997").isEmpty()


def test_exact_ranks_of_hot_and_tied_keys(spark):
    data = [(None if i % 3 else "k", 1.0 if i % 5 else float(-i), i) for i in range(3000)]
    df = spark.createDataFrame(data, "key string, v double, id int").repartition(5)
    got = exact_ranks(df, ["key"], [F.desc("v"), F.col("id")], total="n")
    assert got.columns == ["key", "v", "id", "rank", "n"]
    for key in (None, "k"):
        want = sorted((-v, i) for k, v, i in data if k == key)
        mine = sorted((r["rank"], r["id"]) for r in got.collect() if r["key"] == key)
        assert mine == [(p + 1, i) for p, (_, i) in enumerate(want)]
    assert {(r["key"], r["n"]) for r in got.collect()} == {(None, 2000), ("k", 1000)}
    assert exact_ranks(df.limit(0), ["key"], [F.col("id")]).isEmpty()


def test_sam_of_data_sets_equals_each_by_itself(spark):
    data = [(s, f"g{g}", i, (3.0 if g < 3 and i < 5 else 0.0) + RNG.random(), int(i < 5)) for s in ("a", "b", None) for g in range(30) for i in range(10)]
    data += [("one class", f"g{g}", i, RNG.random(), 1) for g in range(4) for i in range(4)]
    df = spark.createDataFrame(data, "dataset string, gene string, sample int, value double, cls int")
    got = ex.analyse_all(df, "sam")
    for name in ("a", "b", None):
        alone = ex.sam(df.filter(F.col("dataset").eqNullSafe(F.lit(name))).drop("dataset"))
        mine = {r["gene"]: (r["d"], r["changed"]) for r in got.collect() if r["dataset"] == name}
        assert mine == {r["gene"]: (pytest.approx(r["d"]), r["called"]) for r in alone.collect()}
        assert all(mine[f"g{g}"][1] for g in range(3)) and len(mine) == 30
    assert got.filter("dataset = 'one class'").isEmpty()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101, 1024])
def test_permute_labels_is_a_permutation_of_any_size(spark, n):
    pool = spark.range(n).select(F.concat(F.lit("i"), "id").alias("item"))
    flip = permute_labels(pool.union(pool), "item", 5, seed=3).collect()
    names = sorted(f"i{k}" for k in range(n))
    for rep in range(5 if n else 0):
        assert sorted(r["item"] for r in flip if r["rep"] == rep) == sorted(r["relabelled"] for r in flip if r["rep"] == rep) == names
    assert len(flip) == 5 * n


def test_permute_labels_spreads_evenly(spark):
    n, reps = 12, 3000
    cells = permute_labels(spark.range(n).withColumnRenamed("id", "item"), "item", reps).groupBy("item", "relabelled").count().collect()
    assert len(cells) == n * n
    chi = sum((r["count"] - reps / n) ** 2 / (reps / n) for r in cells)
    assert chi < 121 + 5 * (2 * 121) ** 0.5  # (n - 1)^2 degrees of freedom


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 11], "a long, b long")
    got = dict(rows(network.components(edges), "id", "component"))
    assert all(got[i] == got[i + 1] for i in range(40) if i % 11) and len(set(got.values())) == 4


def test_partition_agreement(spark):
    p = spark.createDataFrame([(i, i % 4) for i in range(40)], "sample int, cluster int")
    self_counts = pt.pair_counts(p, p)
    assert pt.ari(self_counts).first()["ari"] == pytest.approx(1.0) and pt.jaccard(self_counts).first()["jaccard"] == 1.0
    q = spark.createDataFrame([(i, i // 7) for i in range(40)], "sample int, cluster int")
    r = pt.pair_counts(p, q).first()
    pairs = [((a % 4 == b % 4), (a // 7 == b // 7)) for a, b in itertools.combinations(range(40), 2)]
    assert (r["nss"], r["nsd"], r["nds"], r["ndd"]) == tuple(pairs.count(x) for x in ((True, True), (True, False), (False, True), (False, False)))


def test_spline_and_value_at(spark):
    x, y = np.array([0.0, 2, 5, 9]), np.array([1.0, 3, 2, 8])
    assert cl.spline_through(x, y, x) == pytest.approx(y) and np.isnan(cl.spline_through(x, y, np.array([-1.0, 10.0]))).all()
    line = np.array([0.0, 1, 4])
    assert cl.spline_through(line, 2 * line, np.array([3.0])) == pytest.approx([6.0])
    tl = spark.createDataFrame([(1, 0, "RNA", 78.0), (1, 4, "RNA", 140.0)], "pat int, week int, kind string, val double")
    got = {r["time"]: r["val"] for r in cl.value_at(tl, [-50, 2, 500]).collect()}
    assert got[-50] is None and got[500] is None and 78 < got[2] < 140


def test_mixture_separates_two_normals(spark):
    gen = np.random.default_rng(3)
    values = np.concatenate([gen.normal(-4, 1, 300), gen.normal(5, 0.5, 200)])
    expr = spark.createDataFrame([("g", float(v)) for v in values], "gene string, value double")
    g = mx.fit_gmm2(expr)
    r = g.first()
    assert r["m1"] == pytest.approx(-4, abs=0.3) and r["m2"] == pytest.approx(5, abs=0.3) and r["w1"] == pytest.approx(0.6, abs=0.05)
    assert mx.bimodality(expr, g).first()["bimodal"] and -3 < mx.gmm_threshold(g).first()["threshold"] < 5


def test_mixture_in_several_arrays_equals_one(spark, monkeypatch):
    gen = np.random.default_rng(5)
    rows = [("two", float(v)) for v in [*gen.normal(0, 1, 400), *gen.normal(4, 2, 300)]] + [("flat", float(v)) for v in gen.normal(1, 3, 500)]
    rows += [("same", 2.0)] * 9 + [("null", None), ("one", 1.0)]
    expr = spark.createDataFrame(rows, "gene string, value double")
    assert mx.fit_gmm2(expr).filter("not settled").count() == 0
    for percent in (None, 0.05):
        whole = {r["gene"]: r for r in mx.fit_gmm2(expr, percent, max_rounds=11).collect()}
        assert set(whole) == {"two", "flat", "same", "one"}
        monkeypatch.setattr(mx, "CHUNK", 150)
        parts = {r["gene"]: r for r in mx.fit_gmm2(expr, percent, max_rounds=11).collect()}
        monkeypatch.undo()
        for gene, r in whole.items():
            assert parts[gene]["rounds"] == r["rounds"]
            assert [parts[gene][c] for c in ("w1", "m1", "s2", "loglik")] == pytest.approx([r[c] for c in ("w1", "m1", "s2", "loglik")], rel=1e-6)
    assert mx.fit_gmm2(expr, max_rounds=3).filter("not settled").count() >= 1
    assert mx.fit_gmm2(expr.limit(0)).count() == 0


def test_knn_search_ranks_features_and_takes_consensus(spark):
    gen = np.random.default_rng(2)
    vec = gen.normal(0, 1, (240, 20))
    cls = np.arange(240) % 2
    vec[:, 17] += 3 * cls  # informative features behind the first sixteen
    vec[:, 19] -= 3 * cls
    rows = [(k, int(c), [float(x) for x in v]) for k, (c, v) in enumerate(zip(cls, vec))]
    df = spark.createDataFrame(rows, "sample long, cls int, vec array<double>")
    assert set(ml.rank_features(df)[:2]) == {17, 19}
    grid = ml.knn_search(df, max_k=5, reps=4)
    best = grid.filter("chosen").collect()
    assert len(best) == 1 and best[0]["rate"] > 0.95 and best[0]["n_features"] >= 2
    whole = {(r["n_features"], r["k"]): (r["classified"], r["correct"]) for r in grid.collect()}
    assert max(k for _, k in whole) == 5 and all(whole[f, k][0] <= whole[f, k - 1][0] for f, k in whole if k > 1 and (f, k - 1) in whole)
    split = {(r["n_features"], r["k"]): (r["classified"], r["correct"]) for r in ml.knn_search(df, max_k=5, reps=4, block=50).collect()}
    assert split == whole


def test_stepwise_finds_the_terms(spark):
    gen = np.random.default_rng(5)
    x = gen.normal(size=(300, 4))
    y = 3 * x[:, 1] - 2 * x[:, 3] + gen.normal(size=300) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y double")
    assert [n for n, _ in ml.stepwise(df, ["a", "b", "c", "d"], "y", 1e-6)] == ["b", "d"]


def test_overlap_outside_background_is_an_error(spark):
    def items(*xs):
        return spark.createDataFrame([(x,) for x in xs], "item int")
    with pytest.raises(Exception, match="outside the background"):
        en.overlap_test(items(1, 2), items(2, 9), items(1, 2, 3)).collect()


def test_bin_search_improves(spark):
    hits = spark.createDataFrame([("m", s, p) for s in range(10) for p in (10, 60, 90)], "motif string, seq_id int, start int")
    first = bn.score_edges(hits, spark.createDataFrame([("m", [0, 50, 100])], "motif string, edges array<int>"), 10, bn.default_objective, []).first()["cost"]
    assert bn.optimise_bins(hits, 10, 100, max_rounds=3).first()["cost"] < first


def test_neighbourhood_sizes(spark):
    w = spark.createDataFrame([("ACGT",)], "seq string")
    assert sc.mismatch_neighbours(w, 2).select("neighbour").distinct().count() == 1 + 4 * 3 + 6 * 9
    weights = {(r["pwm_id"], r["offset"], r["symbol"]): r["weight"] for r in pw.pwm_from_regex(spark, [("x", "A[CG](?:T|A)[^A].")], "ACGT").collect()}
    assert weights[("x", 0, "A")] == 1.0 and weights[("x", 1, "C")] == 0.5 and weights[("x", 3, "G")] == pytest.approx(1 / 3) and weights[("x", 4, "T")] == 0.25


def test_initial_therapy_and_matrix(spark):
    reg = spark.createDataFrame([(1, -3, "X"), (1, 2, "B"), (1, 2, "A"), (2, -1, "C")], "pat int, start int, drug string")
    assert rows(agg.initial_therapy(reg, reg.select("pat"))) == [(1, "A, B"), (2, "Discarded")]
    found = spark.createDataFrame([(1, "f@5")], "pat int, feature string")
    pats = spark.createDataFrame([(1, ["d"], 0, 9), (2, ["d", "c"], 6, 9)], "pat int, drugs array<string>, lo int, hi int")
    assert [tuple(r) for r in sinks.feature_matrix(found, pats, ["f@5"]).orderBy("pat").collect()] == [(1, "d", 1), (2, "c+d", None)]
