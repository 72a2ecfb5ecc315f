"""FASTA files as ``(seq_id, header, seq)`` rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KeyFunction = Callable[[Column], Column]


def parse_records(raw: DataFrame, key: KeyFunction | None = None) -> DataFrame:
    """Records cut at ``\\n>``: header, one-line sequence and id (the trimmed header by default)."""
    record = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.regexp_extract(record, r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"\s", "")
    named = raw.withColumns({"header": header, "seq": body}).drop("value").filter("header <> '' OR seq <> ''")
    return named.withColumn("seq_id", key(F.col("header")) if key else F.col("header"))


def read_fasta(spark: SparkSession, path: str, key: KeyFunction | None = None) -> DataFrame:
    """Sequences of a file or directory; of equal ids the last in file order stays.

    Large files are split between records by the reader. File order is (file, offset of
    the split, place in the split).
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                          F.monotonically_increasing_id().alias("i")).alias("_order"))
    parsed = parse_records(raw, key)
    last = parsed.groupBy("seq_id").agg(F.max_by(F.struct("header", "seq"), "_order").alias("r"))
    return last.select("seq_id", "r.header", "r.seq")


def fasta_text(df: DataFrame, width: int = 50) -> DataFrame:
    """One text value per record, wrapped at ``width`` columns."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 50) -> None:
    fasta_text(df, width).write.text(path)


def parse_header(df: DataFrame, spec: str = "patient", header: str = "header") -> DataFrame:
    """Fields of a header: ``patient`` (PtID and Week numbers) or ``pipe`` (fields 3 and 4)."""
    h = F.col(header)
    if spec == "patient":
        return df.withColumns({
            "pat": F.expr(f"try_cast(regexp_extract(`{header}`, 'PtID\\\\s+(\\\\d+)', 1) AS INT)"),
            "week": F.expr(f"try_cast(regexp_extract(`{header}`, 'Week\\\\s+(-?[0-9.]+)', 1) AS DOUBLE)")})
    if spec == "pipe":
        parts = F.split(h, r"\|")
        return df.withColumns({"accession": F.trim(F.get(parts, F.lit(2))), "name": F.trim(F.get(parts, F.lit(3)))})
    raise ValueError(f"unknown header layout {spec}")
