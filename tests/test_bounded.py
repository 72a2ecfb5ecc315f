"""Steps over pairs that keep to rows and counts of bounded size, against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strandframe.functions import scalars as sc
from strandframe.operators import aggregates as agg, bins, enrichment as en, features as ft, joins, pwm
from strandframe.operators.sampling import permute_labels


def test_partitions_are_condensed_where_their_rows_are(spark):
    runs = {1: "aabbc", 2: "xxyyz", 3: "aabbb", 4: "ccaab", 5: "aabcb"}
    rows = [(i, s, c) for i, text in runs.items() for s, c in enumerate(text)] + [(6, 1, None), (None, 1, "a"), (7, 3, "q"), (7, 3, "r"), (8, 3, "q"), (8, 3, "q"), (9, None, "a")]
    out = agg.partition_modes(spark.createDataFrame(rows, "iter int, sample int, cluster string"), 9)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 2  # for the modes and for their share
    got = {(r["first_iter"], r["n_clusters"], r["n"]) for r in out.collect()}
    # one sample in two clusters of a name counts like two rows of it; lost runs and clusters count for nothing
    assert got == {(1, 3, 3), (3, 2, 1), (5, 3, 1), (7, 1, 2), (9, 0, 1)}


def test_pairs_with_a_large_dictionary_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "DICTIONARY_ROWS", 2)
    out = joins.pair_all(spark.range(5).withColumnRenamed("id", "a"), spark.range(40).withColumnRenamed("id", "b"), 4)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.select("a", "b").collect()} == {(a, b) for a in range(5) for b in range(40)}


def test_fuzzy_join_of_equal_features_grows_with_the_features(spark):
    def feats(n, step):
        return [(k * step, "t" if k % 5 else None, "n" * (k % 2), k % 3 * 4, "t" if k % 4 == 0 else None, k % 3 if k % 4 == 0 else None) for k in range(n)]
    a, b = feats(240, 2), feats(180, 3)
    as_frame = lambda rows: spark.createDataFrame(rows + rows[:1], "feat_id int, type string, name string, start int, gene string, rel_start int")
    pairs = {(r["feat_id"], r["feat_id_b"], r["distance"]) for r in ft.fuzzy_join(as_frame(a), as_frame(b), 5, 2).collect()}
    rows = [tuple(r) for r in ft.fuzzy_join_classes(as_frame(a), as_frame(b), 5, 2).select("part", "feat_id", "other_id", "distance").collect()]
    members = {p: [(f, c) for part, f, c, _ in rows if part == p] for p in "ab"}
    links = [r[1:] for r in rows if r[0] == "link"]
    assert len(members["a"]) == 241 and len(members["b"]) == 181 and len(links) * 20 < len(pairs)
    whole = {(f, g, d) for x, y, d in links for f, c in members["a"] if c == x for g, e in members["b"] if e == y}
    assert whole == pairs


def test_pairs_of_sets_are_counted_where_their_items_are(spark, monkeypatch):
    r = random.Random(5)
    sets = [(s, r.randrange(30)) for s in range(40) for _ in range(8)] + [(None, 1), (50, None), (51, 99)]
    df = spark.createDataFrame(sets + sets[:9], "set_id int, item int")
    held = {}
    for s, x in sets:
        held.setdefault(s, set()).add(x)
    both = {(i, j): len((held[i] & held[j]) - {None}) for i in held for j in held if i is not None and j is not None and i < j}
    for items in (1 << 20, 3):  # with 3 every set is a very long one
        monkeypatch.setattr(joins, "ITEMS_PER_TASK", items)
        out = joins.shared_counts(df)
        assert {(x["i"], x["j"]): x["shared"] for x in out.collect()} == {p: n for p, n in both.items() if n}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("ENSURE_REQUIREMENTS" in plan.split("Generate explode(_js")[0]) == (items == 3)  # pairs are not dealt out again
    for blocks in (512, 2):
        monkeypatch.setattr(joins, "SETS_PER_BLOCK", blocks)
        grid = joins.all_pairs(df)
        assert {(x["i"], x["j"]): x["shared"] for x in grid.collect()} == {p: n or -1 for p, n in both.items()}
        assert not re.search(r"hashpartitioning\(i#\d+L?, j#", grid._jdf.queryExecution().executedPlan().toString().split("Generate")[0])


def test_fuzzy_join_query_returns_every_pair(spark, tmp_path, monkeypatch):
    import __spark_entry__ as contract
    parts = [(k, f"B{k % 2}", [3, 4, 5][k % 3], 900.0 + k) for k in range(40)] + [(7, "B1", 4, 907.0), (None, "B0", 3, 990.0), (41, None, 3, 990.0)]
    lines = [(k % 3, k, k % 4, "ANR"[k % 3], float([3, 4, 5][k % 3])) for k in range(1, 40)]
    lines += lines[:5] + [(None, 4, 1, "A", 3.0), (1, 4, 1, None, 3.0), (1, 5, 2, "N", None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    feats = {((o * 10000000 + p) * 10 + n if o is not None else None, f, brand, int(q) * 10 + n if q is not None else None, o)
             for o, p, n, f, q in lines for k, brand, _, _ in parts if k == p}
    refs = [(k, "ANR"[size % 3], brand, size * 10) for k, brand, size, price in parts if price > 905]
    want = []
    for f, kind, name, start, _ in feats:
        for g, kind_b, name_b, start_b in refs:
            if None in (kind, name, name_b) or kind != kind_b or name != name_b or start is None:
                continue
            relative = f is not None and g is not None and f % 2 == 0 and g % 3 == 0
            d = abs(start % 50 - start_b % 50) if relative else abs(start - start_b)
            want += [(f, g, d)] if d < (5 if relative else 8) else []
    for rows in (65_536, 2):
        monkeypatch.setattr(ft, "PLACE_ROWS", rows)
        found = contract.queries()["v20_fuzzy_join"](spark, str(tmp_path))
        assert Counter(tuple(r) for r in found.select("feat_id", "feat_id_b", "distance").collect()) == Counter(want)
    assert len(want) > 100


def test_relabelled_lists_are_not_stored_for_each_repetition(spark, monkeypatch):
    r = random.Random(7)
    sets = [(s, f"g{r.randrange(60)}") for s in range(9) for _ in range(12)] + [(s, "g1") for s in range(9)] + [(None, "g2"), (3, None), (4, "unknown")]
    df = spark.createDataFrame(sets + sets[:20], "set_id int, item string")
    universe = spark.createDataFrame([(f"g{k}",) for k in range(60)] + [("g3",), (None,)], "item string")
    flip = {(x["rep"], x["item"]): x["relabelled"] for x in permute_labels(universe, "item", 7, 2).collect()}
    held = {s: {x for t, x in sets if t == s} - {None} for s, _ in sets if s is not None}
    want = {}
    for rep in range(7):
        for i in held:
            for j in held:
                n = len(held[i] & ({flip.get((rep, x)) for x in held[j]} - {None}))
                if i < j and n:
                    want[rep, i, j] = n
    stored = []

    def cut(rows):
        out = real(rows)
        stored.append(out.count())
        return out

    real = en.cut_lineage
    monkeypatch.setattr(en, "cut_lineage", cut)
    for cap in (64, 4):  # with 4 most items are in too many lists to be paired directly
        monkeypatch.setattr(en, "ITEM_CAP", cap, raising=False)
        found = en.random_overlaps(df, universe, 7, 2)
        assert {(x["rep"], x["i"], x["j"]): x["shared"] for x in found.collect()} == want
        if cap == 64:
            assert max(stored) <= 61
    assert len(want) > 100


def test_open_frames_equal_the_search_by_pattern(spark):
    r = random.Random(9)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("ACGT", "ATG", "acgtN", "ATGß\u0130é\U0001f600", "TAGM*") for n in (0, 2, 3, 5, 300, 2000)]
    df = spark.createDataFrame(list(enumerate([*texts, None, "ATG", "ATGTAA", "xxATGATGA"])), "seq_id int, seq string")
    frames = F.array(*[F.struct(F.lit(f).alias("frame"), sc.overlap_hits(sc.translate_codons(F.substring("seq", f + 1, 2**31 - 1), False), "M[^*]*").alias("hits")) for f in range(3)])
    want = df.select("seq_id", F.inline(frames)).select("seq_id", "frame", F.inline("hits")).select("seq_id", "frame", F.col("start") * 3 + F.col("frame"), "text")
    found = sc.orfs(df)
    assert found.columns == ["seq_id", "frame", "start", "protein"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "element_at" not in found._jdf.queryExecution().executedPlan().toString()  # codons are not looked up one by one


def test_small_ranges_go_to_the_points(spark):
    points = spark.range(5000).select((F.col("id") % 7).alias("seq_id"), F.lit("m").alias("pwm_id"), F.col("id").cast("int").alias("start"), (F.col("id") * 7919 % 1009).cast("double").alias("score"))
    bins = spark.createDataFrame([("m", 0, 0, 900), ("m", 1, 900, 4999), ("o", 0, 0, 50)], "motif string, bin_id int, lo int, hi int")
    found = pwm.pwm_binned_max(points, bins)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    want = {}
    for k in range(4999):
        key = (k % 7, int(k >= 900))
        want[key] = max(want.get(key, -1.0), float(k * 7919 % 1009))
    assert {(x["seq_id"], x["bin_id"]): x["score"] for x in found.collect()} == want


def test_bins_are_counted_from_steps_that_sequences_share(spark):
    r = random.Random(11)
    base = sorted(r.sample(range(400), 12))
    hits = [("m", s, x + s % 2) for s in range(60) for x in base if r.random() < 0.9] + [("n", 1, 5), ("n", 2, None)]
    bins_ = [("m", lo, lo + w) for lo in range(0, 400, 35) for w in (1, 20, 64, 150)] + [("n", 0, 9)]
    spots = bins._spots(spark.createDataFrame(hits + hits[:40], "motif string, seq_id int, start int"))
    steps = bins._steps(spots)
    assert steps.count() * 3 < spots.count() * 2
    got = {tuple(x)[:3]: tuple(x)[3:] for x in bins.occupancy(steps, spark.createDataFrame(bins_, "motif string, lo int, hi int")).collect()}
    for motif, lo, hi in bins_:
        per = Counter(s for m, s, x in set(hits) if m == motif and x is not None and lo <= x < hi)
        one, more = sum(n == 1 for n in per.values()), sum(n > 1 for n in per.values())
        assert got.get((motif, lo, hi), (0, 0)) == (one, more)
