"""The corpus pipeline: stages from raw documents to a sampled training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as
Parquet and reads it back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.llm import decontam, jaccard, lines, mixing, quality
from strandframe.llm.rows import pack, unpack
from strandframe.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior quality is at least one half."""
    judged = quality.quality(pack(docs, text=F.col("text")))
    return unpack(judged.filter("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three or more lines stay where they come first."""
    return lines.line_dedup_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of documents with five-word Jaccard similarity 0.8 or more."""
    return jaccard.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with their topic, token count, weight and probability."""
    return mixing.mix_sources(docs).filter("sampled").drop("sampled")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Stages run Python on the executors, so no SQL says the same; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
