"""The corpus pipeline, stage by stage, against brute force on the stage's own input."""

import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import mixing, quality
from tests.llm.test_native import brute_lines
from tests.llm.test_python import brute_edits, brute_facts, brute_groups

SF_DIR = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    again = docs.filter("doc_id = 7").first()
    extra = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "src0", 0), tuple(again), tuple(again)], docs.schema)
    docs = docs.unionByName(extra).withColumn("weight", F.lit("clash"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix"]

    rows = pairs(docs)
    seen = {t: quality.facts((t or "").encode()) for _, t in rows}
    vote = {t: quality.pattern(quality.votes(s)) for t, (_, s) in seen.items()}
    _, _, post = quality.estimate(collections.Counter(vote[t] for _, t in rows))
    kept = stages["quality_rules"](spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert collections.Counter(pairs(kept)) == collections.Counter((i, t) for i, t in rows if not brute_facts(t)[5] and post[vote[t]] >= 0.5)

    lines = stages["line_dedup"](spark, kept, SF_DIR)
    before = pairs(kept)
    want = [(i, new) for (i, old), (_, new) in zip(before, brute_lines(before)) if new == old or new.strip()]
    assert collections.Counter(pairs(lines)) == collections.Counter(want)

    near = stages["near_dedup"](spark, lines, SF_DIR)
    before = pairs(lines)
    groups = brute_groups([t for _, t in before])
    assert near.columns == docs.columns and len(groups) < len(before)
    assert sorted(i for i, _ in pairs(near)) == sorted(min(before[k][0] for k in g) for g in groups)

    clean = stages["decontaminate"](spark, near, SF_DIR)
    items = [re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", r.text.lower()).split() for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]

    def leaks(text):
        words = re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.lower()).split()
        grams = {tuple(words[k:k + 3]) for k in range(len(words))}
        near_items = [x for x in items if any(tuple(x[k:k + 3]) in grams for k in range(len(x) - 2))]
        return any(brute_edits(x, words) <= len(x) // 5 for x in near_items)

    assert sorted(i for i, _ in pairs(clean)) == sorted(i for i, t in pairs(near) if not leaks(t))

    mixed = stages["mix"](spark, clean, SF_DIR)
    marked = mixing.mix_sources(clean)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in marked.filter("sampled").collect()}
    assert 0 < mixed.count() <= clean.count() and "probability" in mixed.columns


def test_run_writes_each_stage(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 0 and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)
    assert out.count() == out.select("doc_id").distinct().count()
