"""Steps that must not grow past their limits, on rows that tempt them to."""

import itertools
import random

from pyspark.sql import functions as F

from strandframe.llm import jaccard
from strandframe.operators import features as ft, joins, motifs as mt
from strandframe.session import cut_lineage


def bag(df):
    return sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())


def test_repeated_lists_are_not_sent_to_the_driver(spark):
    rows = spark.range(300).select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("rep"), (F.col("id") % 6).alias("i"), F.floor(F.col("id") / 6).alias("x"))
    left = cut_lineage(rows)
    found = joins.overlap_counts(left, left.withColumnRenamed("i", "j"), ["rep"])
    assert found.count() == 20 * 15 and {r.shared for r in found.collect()} == {50}
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_are_held_against_pivots_first(spark):
    rng = random.Random(1)
    prints = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(6)]
    prints += [(a ^ 1 << rng.randrange(64), b ^ 3 << rng.randrange(60)) for a, b in prints]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, signed(a), signed(b), jaccard.pivot_row(a, b)) for k, (a, b) in enumerate(prints)]
    df = spark.createDataFrame(rows, "id int, f1 long, f2 long, pivots long").withColumns({"n": F.lit(100), "place": F.lit(0)})
    one = df.select(F.struct("*").alias("x")).crossJoin(df.select(F.struct("*").alias("y")))
    met = {(r[0], r[1]) for r in one.filter(jaccard.likely(F.col("x"), F.col("y"))).select("x.id", "y.id").collect()}
    apart = lambda p, q: (p[0] ^ q[0]).bit_count() + (p[1] ^ q[1]).bit_count()
    assert met == {(a, b) for a, b in itertools.product(range(12), repeat=2) if apart(prints[a], prints[b]) <= jaccard.RADIUS}
    # rows of the table that lie too far apart discard a pair whatever its bits
    far = one.filter("x.id = 0 AND y.id = 0").withColumn("y", F.col("y").withField("pivots", F.lit(0).cast("long")))
    assert min(jaccard.pivot_row(*prints[0]).to_bytes(8, "big", signed=True)) > jaccard.RADIUS
    assert far.filter(jaccard.likely(F.col("x"), F.col("y"))).count() == 0


def test_equal_wanted_features_are_matched_by_class(spark):
    rng = random.Random(2)
    feats = [(s, 100 * s + k, rng.choice("AB"), "n", rng.randrange(60)) for s in range(8) for k in range(4)]
    feats.append((None, 9999, "A", "n", 5))
    wanted = [(w, rng.choice("AB"), "n", rng.choice([10, 20, 50])) for w in range(40)] + [(3, "A", "n", 10), (3, "A", "n", 10)]
    f = spark.createDataFrame(feats, "seq_id long, feat_id long, type string, name string, start int")
    w = spark.createDataFrame(wanted, "want_id long, type string, name string, start int")
    expected = []
    for s in range(8):
        pairs = sorted({(abs(x[4] - y[3]), y[0], x[1]) for x in feats for y in wanted if x[0] == s and x[2] == y[1] and abs(x[4] - y[3]) < 25})
        used_w, used_f = set(), set()
        for d, want, feat in pairs:
            if want not in used_w and feat not in used_f:
                used_w.add(want), used_f.add(feat)
                expected.append((s, want, feat, d))
    got = ft.match_features(f, w, 25)
    assert sorted((r.seq_id, r.want_id, r.feat_id, r.distance) for r in got.collect()) == sorted(expected)


def test_anchor_costs_of_equal_features(spark):
    feats = [(1, "A", "n", 10), (1, "A", "n", 14), (2, "A", "n", 90), (2, "B", "n", 12), (2, "B", "n", 12), (None, "A", "n", 11)]
    refs = [(1, "A", "n", 12), (2, "A", "n", 12), (3, "B", "n", 400), (4, "A", "n", 88), (4, "A", "n", 9), (None, "A", "n", 12), (5, None, "n", 12), (2, "A", "n", 12)]
    f = spark.createDataFrame(feats, "seq_id long, type string, name string, start int")
    r = spark.createDataFrame(refs, "feat_id long, type string, name string, start int")
    want = {1: 2 + 1 + 2 * 50, 2: 2 + 1 + 2 * 50, 3: 4 * 50, 4: 1 + 2 + 2 + 1 * 50, None: 4 * 50, 5: 4 * 50}
    got = ft.anchor_costs(r, f, 4, 20, 50)
    assert sorted((str(x.ref_feat), x.cost) for x in got.collect()) == sorted((str(i[0]), want[i[0]]) for i in refs)


def test_closest_match_lets_out_ties_only(spark):
    rng = random.Random(3)
    texts = ["", None, "she", "".join(rng.choice("shen") for _ in range(9000)), "xxshen", "sh\u00e9n\U0001f600hen", "zzzz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id int, seq string")
    want = []
    for i, t in enumerate(texts):
        at = [(sum(c != q for c, q in zip(t[k:k + 4], "shen")), k, t[k:k + 4]) for k in range(len(t or "") - 3)]
        want += [str([w, m, "forward", i, k]) for m, k, w in at if m == min(at)[0]]
    found = mt.closest_match(df, "shen", both_strands=False)
    assert bag(found.select("seq_id", "start", "mismatches", "match", "orientation")) == sorted(want)
    assert "places" in found._jdf.queryExecution().optimizedPlan().toString()  # not every placement is a row
