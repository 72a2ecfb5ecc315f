"""Line de-duplication, mixing and chat formatting on small fixtures."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandframe.llm import chat, lines, mixing
from strandframe.llm.plans import ORACLES, QUERIES
from tests.oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name]) is None


def brute_lines(rows, width=3):
    """Sets of (id, text) pairs; ids and texts may be null."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for i, t in docs:
        ls = t.split("\n")
        gone[i, t] = set()
        for p in range(len(ls) - width + 1):
            w = tuple(ls[p:p + width])
            if any(w):
                gone[i, t] |= set(range(p, p + width)) if w in seen else set()
                seen.add(w)
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in rows]


def test_line_dedup_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "", "longer line é"]) for _ in range(rnd.randrange(0, 12)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "\n\n\n\n"), (83, "x\n" * 3000), rows[5], (None, "p\nq\nr"), (90, "p\nq\nr\ns"), (91, "one\ntwo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.text) for r in lines.dedup_lines(df).collect()]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(got, key=key) == sorted(brute_lines(rows), key=key)


def test_line_dedup_edges(spark):
    clash = "doc_id long, text string, _pos int, h1 int, n_lines string, __starts int, _first int"
    out = lines.dedup_lines(spark.createDataFrame([(1, "a\nb\nc", 1, 2, "x", 3, 4), (2, "z\na\nb\nc", 1, 2, "x", 3, 4)], clash))
    assert {(r.doc_id, r.text, r.n_lines, r.removed_lines, r._pos) for r in out.select("doc_id", "text", "n_lines", "removed_lines", "_pos").collect()} == {
        (1, "a\nb\nc", 3, 0, 1), (2, "z", 4, 3, 1)}
    assert lines.dedup_lines(spark.createDataFrame([], DOC)).count() == 0
    stage = lines.line_dedup_stage(spark.createDataFrame([(1, "a\nb\nc", None, None, None), (2, "a\nb\nc", None, None, None), (3, None, None, None, None)], DOC))
    assert {r.doc_id for r in stage.collect()} == {1, 3} and stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mixing_meets_targets(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 40)) + rnd.choice(["", " ####", "!!!!"]), rnd.choice(["en", "en", "de", None]),
             rnd.choice(["hot"] * 6 + ["a", "b"]), 1) for i in range(600)]
    rows += [(900, None, "en", "hot", 1), (901, "", None, None, 1), rows[0]]
    df = spark.createDataFrame(rows, DOC).withColumn("weight", F.lit("clash"))
    out = mixing.mix_sources(df).cache()
    assert out.count() == len(rows)
    for c, label in (("source", "source"), ("lang", "lang"), ("topic", "topic")):
        sums = {r[c]: (r.n, r.w) for r in out.groupBy(c).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("weight")).alias("w")).collect()}
        raised = {k: n ** mixing.TEMPER[label] for k, (n, _) in sums.items() if n}
        total = sum(n for n, _ in sums.values())
        for k, p in raised.items():
            assert sums[k][1] / total == pytest.approx(p / sum(raised.values()), abs=1e-6)
    top = out.agg(F.max("probability")).first()[0]
    assert top == pytest.approx(1.0) and {r.probability for r in out.filter("doc_id >= 900").collect()} == {0.0}
    drawn = {r.doc_id: float(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16)) / 2**32 < r.probability for r in out.collect()}
    assert drawn == {r.doc_id: r.sampled for r in out.collect()}


def test_mixing_empty_and_contradictory(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOC)).count() == 0
    cells = spark.createDataFrame([("x", "p", 5), ("y", "q", 5)], "a string, b string, n long")
    share = lambda c, *v: spark.createDataFrame(list(zip(*v)), f"{c} string, share double")
    with pytest.raises(RuntimeError):
        mixing.rake(cells, {"a": share("a", ["x", "y"], [0.3, 0.7]), "b": share("b", ["p", "q"], [0.6, 0.4])}, max_rounds=4)


def test_mixing_with_one_language_sources(spark):
    rows = [(k, "word " * 10, "x" if k < 10 else "y", "a" if k < 10 else "b", 1) for k in range(40)]  # 100 and 300 tokens
    with pytest.warns(UserWarning, match="no weights meet all targets"):
        out = mixing.mix_sources(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == 40
    share = {t: sum(r.weight * r.n_tokens for r in out if r.source == t) / 400 for t in "ab"}
    lang = 100**0.8 / (100**0.8 + 300**0.8)  # scaled after the source and kept by the one topic
    source = 100**0.7 / (100**0.7 + 300**0.7)
    assert share["a"] == pytest.approx(lang, abs=1e-9) and share["a"] + share["b"] == pytest.approx(1)
    assert {round(r.gap.source, 9) for r in out if r.source == "a"} == {round(lang - source, 9)}
    assert all(abs(r.gap.lang) < 1e-9 and abs(r.gap.topic) < 1e-9 for r in out)
    # a null language that only one source has, beside languages of several sources
    rows += [(50 + k, "word " * (k + 3), None, "c", 1) for k in range(5)] + [(60 + k, "word " * 7, "x", "b", 1) for k in range(4)]
    with pytest.warns(UserWarning, match="no weights meet all targets"):
        out = mixing.mix_sources(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == 49 and all(0 < r.probability <= 1 for r in out)


def test_chat_round_trip(spark):
    texts = ["", "hi", "<turn:user>", "</turn>", "a\\0b\\", "<part>\\1<", "line\nline", "\\\\2>>", None, "é" * 5000]
    rows, k = [], 0
    for conv, roles in enumerate(itertools.product(["user", "assistant", None, "sys>tem"], repeat=3)):
        for t, role in enumerate(roles):
            rows.append((conv, t, role, texts[k % len(texts)], 1))
            k += 1
    rows += [(None, 0, "user", "null id", 1), (1000, None, "assistant", "no turn", 1), (1000, 0, "user", "b", 1), (1000, 0, "user", "a", 1), (1000, 0, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask int")
    got = {r.conv_id: r for r in chat.format_chats(df).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("mask")).alias("loss"),
        F.expr("aggregate(mask, 0, (a, x) -> a + x.n_chars)").alias("chars"), F.length("formatted").alias("n")).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert {c: r.loss for c, r in got.items()} == {c: "".join(t for r, t in ts if r == "assistant") for c, ts in want.items()}
    assert all(r.chars == r.n for r in got.values())
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_native_plans_run_no_python(spark):
    for name in ("op1_line_dedup", "op2_mix_sources", "op8_chat_format"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
