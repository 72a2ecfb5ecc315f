"""Queries on packed columns against the letter form, on odd documents: repeated rows, empty, null and long texts, gaps."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from strandframe.functions.scalars import CODONS
from strandframe.operators import pileup as pu
from strandframe.plans.motifs import MOTIFS
from strandframe.plans.views import pileup, seqs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables whose documents and conversations are folders of several files."""
    rng = random.Random(4)
    first = "".join(rng.choice("abc -") for _ in range(4200))
    texts = [first, first[:90], "", None, "12 -", first[:50] + "x" + first[51:4300], "the nation - then", first[2000:], "- - -" + first[5:4150]]
    texts += ["".join(c if rng.random() < 0.8 else rng.choice("abz -") for c in first[:rng.randrange(5, 300)]) for _ in range(25)]
    rows = [(7 + i, t) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], rows[5], rows[6], (None, first[:40]), (None, first[:40])]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, k, "user", f"turn {k % 7}") for k in range(40)], "conv_id long, turn int, role string, text string").repartition(4).write.parquet(f"{at}/conversations.parquet")
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(f"{at}/nation.parquet")
    return str(at)


def bag(df):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())


def letters(spark, d):
    return pu.run_lengths(pileup(spark, d))


def sites(spark, d):
    return pu.snp_sites(letters(spark, d), min_run=2)


def mapped(spark, d):
    gap = [F.when(F.col(c) == " ", "-").otherwise(F.col(c)).alias(c) for c in ("base", "ref_base")]
    return pu.coord_map(pileup(spark, d).select("seq_id", F.col("ref_pos").alias("col"), *gap))


def lifted(spark, d):
    m = mapped(spark, d)
    return pu.lift_range(m, m.select("seq_id").distinct().select("seq_id", F.lit(30).alias("start"), F.lit(90).alias("end")))


def multi(spark, d):
    s = seqs(spark, d)
    found = pu.islands_multi(letters(spark, d).withColumn("ref_id", F.lit("ref")), 1, [0.002, 0.01])
    ref = s.groupBy().agg(F.min(F.struct("seq_id", "seq")).alias("r")).select(F.lit("ref").alias("ref_id"), F.col("r.seq").alias("seq"))
    return pu.confirm_islands(found, ref, s)


FORMS = {
    "v11_snp_sites": sites,
    "v12_base_calls": lambda s, d: pu.base_calls(pileup(s, d), sites(s, d)),
    "v19_snp_counts": lambda s, d: pu.snps_per_sequence(pileup(s, d), sites(s, d)),
    "v19_log_mean_island": lambda s, d: pu.log_mean_island(letters(s, d)).filter("log_run IS NOT NULL"),
    "v16_islands": lambda s, d: pu.islands(letters(s, d).withColumn("ref_id", F.lit("ref")), 2, 0.01),
    "v17_islands_multi": multi,
    "v26_intervals_with_sites": lambda s, d: pu.intervals_with_sites(
        s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 20).alias("start"), (F.col("n_nationkey") * 20 + 10).alias("end")), sites(s, d)),
    "v8_mask_fragments": lambda s, d: pu.mask_fragments(pileup(s, d)).groupBy("seq_id").agg(F.count("*").alias("n"), F.count("base").alias("n_inside")),
    "v5_coord_map": lambda s, d: mapped(s, d).groupBy("seq_id").agg(F.sum("test_pos").alias("sum_test"), F.sum("ref_pos").alias("sum_ref")),
    "v6_lift_range": lifted,
}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_packed_query_equals_letter_form(spark, folder, name):
    found = contract.queries()[name](spark, folder)
    want = FORMS[name](spark, folder)
    assert dict(found.dtypes) == dict(want.dtypes) and found.count() > 0
    assert bag(found) == bag(want)
    # a row per run, site or sequence, but none per letter, save those of the reference
    assert name in ("v5_coord_map", "v6_lift_range") or "split(_text" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_streams_read_folders_of_files(spark, folder):
    hits = contract.queries()["t1_stream_scan"](spark, folder)
    want = contract.queries()["m1_scan_motifs"](spark, folder)
    assert {r.motif for r in hits.collect()} <= {n for n, _ in MOTIFS}
    assert bag(hits.select("motif", "n_hits")) == bag(want.groupBy("motif").agg(F.count("*").alias("n_hits")))
    assert contract.queries()["t2_stream_dedupe"](spark, folder).count() == 7


def _texts(spark, path, docs, parts=()):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(p,) for p in parts], "p_partkey long").write.parquet(f"{path}/part.parquet")


def test_distances_to_the_next_mismatch_are_summed_in_pieces(spark, tmp_path):
    r = random.Random(3)
    ref = "".join(r.choice("ab") for _ in range(9000))
    docs = [(1, ref), (2, ref[:8500] + "zz"), (3, "".join(c if r.random() < 0.999 else "z" for c in ref)), (4, "z" * 4096 + ref[4096:5000]),
            (5, ref[:4096]), (6, ref + "--"), (7, ""), (8, None), (None, ref), (9, ref[:4095] + "z" + ref[4096:4200] + "y")]
    docs += docs[2:3]
    _texts(spark, tmp_path, docs)
    want = {}
    for k, text in docs:
        if k is not None and text is not None:
            n, total = want.get(k, (0, None))
            nxt, dist = None, []
            for i in range(max(len(text), 1) - 1, -1, -1):
                nxt = i if text[i:i + 1] != (ref[i] if i < len(ref) else "-") else nxt
                dist += [] if nxt is None else [nxt - i]
            want[k] = (n + len(dist), (total or 0) + sum(dist) if dist else total)
    out = contract.queries()["v10_distance_to_next"](spark, str(tmp_path))
    assert {x["seq_id"]: (x["n"], x["total"]) for x in out.collect()} == want
    assert "posexplode(split(" not in out._jdf.queryExecution().executedPlan().toString()


def test_mutations_are_judged_in_pieces(spark, tmp_path):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcd") for _ in range(n))
    docs = [(1, text(8300)), (2, text(8290)), (3, text(4097)), (4, text(50)), (5, ""), (6, None)]
    for again in (False, True):
        some = docs + ([(2, docs[1][1]), (None, docs[3][1])] if again else [])
        folder = tmp_path / str(again)
        _texts(spark, str(folder), some, [*range(1, 95), 5, 10**9, None])
        rows = {k: (t or "").upper().translate(str.maketrans("ABCD", "ACGT")) for k, t in some}
        ref = rows[None] if again else rows[1]
        want = Counter()
        for s in rows.values():
            for i in range(min(len(s), len(ref)) // 3):
                a, b = s[3 * i:3 * i + 3], ref[3 * i:3 * i + 3]
                if a != b and i // 30 + 1 < 95:
                    x, y = CODONS[a], CODONS[b]
                    want[i // 30 + 1, 0 if x == y else 2 if "*" in (x, y) else 1] += 1
        out = contract.queries()["v13_classify_mutations"](spark, str(folder))
        assert {(x["gene"], x["mutation_class"]): x["n"] for x in out.collect()} == want
        if not again:
            assert "posexplode(split(" not in out._jdf.queryExecution().executedPlan().toString()
