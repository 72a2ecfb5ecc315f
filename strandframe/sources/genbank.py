"""Flat annotation records: genome features and pathway entries, read as text jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Coding features of genome records: (ref_id, gene, product, note, start, end, aa).

    The first two coordinates of a location count (also inside ``join(...)``); they become
    0-based half-open. Names with a dash are skipped.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1).alias("ref_id"), F.col("value").alias("text"))
    features = files.select("ref_id", F.explode(F.regexp_extract_all(
        "text", F.lit(r"(?m)^     CDS {2,}([\s\S]*?)(?=^     \S|^[A-Z])"), F.lit(1))).alias("cds"))

    def qualifier(name: str):
        return F.regexp_replace(F.regexp_extract("cds", rf'/{name}="([^"]*)"', 1), r"\s+", " ")

    numbers = F.regexp_extract_all(F.regexp_extract("cds", r"^([^/]*)", 1), F.lit(r"(\d+)"), F.lit(1))
    rows = features.select(
        "ref_id", qualifier("gene").alias("gene"), qualifier("product").alias("product"), qualifier("note").alias("note"),
        (numbers[0].cast("int") - 1).alias("start"), numbers[1].cast("int").alias("end"),
        F.regexp_replace(F.regexp_extract("cds", r'/translation="([^"]*)"', 1), r"\s+", "").alias("aa"))
    return rows.filter(~F.contains("gene", F.lit("-")))


def genome_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Nucleotide sequence of each genome record: (ref_id, seq)."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1).alias("ref_id"), F.col("value").alias("text"))
    body = F.regexp_extract("text", r"(?m)^ORIGIN[^\n]*\n([\s\S]*?)(?=^//|\z)", 1)
    return files.select("ref_id", F.upper(F.regexp_replace(body, r"[\s\d]", "")).alias("seq"))


def standardise_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Standard gene name of free text: the one name whose pattern occurs; else the one found with the notes added."""
    table = list(names.items())

    def hits(text):
        found = F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in table])
        return F.array_distinct(F.filter(found, lambda n: n.isNotNull()))

    first = hits(F.col("text"))
    second = hits(F.concat_ws(" ", "text", "note"))
    return df.withColumn("gene", F.coalesce(F.when(F.size(first) == 1, first[0]), F.when(F.size(second) == 1, second[0])))


def read_flat_records(spark: SparkSession, path: str) -> DataFrame:
    """``///``-separated entries: (entry, name, ec).

    ``entry`` is the first word of the ENTRY line under the prefix ``ko:``, ``name`` the first word of
    the line after it, ``ec`` the second word behind DBLINKS (empty without that line).
    """
    records = spark.read.option("lineSep", "///").text(path).filter(F.trim(F.regexp_replace("value", r"\s+", "")) != "")
    return records.select(
        F.concat(F.lit("ko:"), F.regexp_extract("value", r"^\n?\S+\s+(\S+)", 1)).alias("entry"),
        F.regexp_extract("value", r"^\n?[^\n]*\n\S+\s+(\S+)", 1).alias("name"),
        F.regexp_extract("value", r"(?m)^\s*DBLINKS[ \t]+\S+[ \t]+(\S+)", 1).alias("ec"))
