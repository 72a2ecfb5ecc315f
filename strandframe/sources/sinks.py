"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from strandframe.operators.network import canonical


def write_nodes(df: DataFrame, path: str) -> None:
    df.select(F.col("id").cast("string")).distinct().write.text(path)


def write_edges(df: DataFrame, path: str) -> None:
    """Each undirected pair once, tab-separated."""
    canonical(df).write.csv(path, sep="\t")


def feature_matrix(found: DataFrame, patients: DataFrame, features: list[str]) -> DataFrame:
    """Drug prefix and one 0/1 column per feature; NULL where the patient's sequence does not reach.

    ``found(pat, feature)``, ``patients(pat, drugs, lo, hi)`` with covered range, feature
    names ``name@position``.
    """
    wide = found.groupBy("pat").pivot("feature", features).agg(F.lit(1))
    joined = patients.join(wide, "pat", "left")

    def flag(name: str):
        at = int(name.rsplit("@", 1)[1]) if "@" in name else None
        value = F.coalesce(F.col(f"`{name}`"), F.lit(0))
        return (F.when(F.lit(at).between(F.col("lo"), F.col("hi")), value) if at is not None else value).alias(name)

    return joined.select("pat", F.concat_ws("+", F.sort_array("drugs")).alias("regimen"), *[flag(n) for n in features])


def write_feature_matrix(found: DataFrame, patients: DataFrame, features: list[str], path: str) -> None:
    feature_matrix(found, patients, features).write.csv(path, sep="\t", header=True, nullValue="NaN")


def flatten_for_export(df: DataFrame) -> DataFrame:
    """Arrays joined by ', ' and empty cells set to one blank, for spreadsheets."""
    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        text = F.concat_ws(", ", c.cast("array<string>")) if isinstance(f.dataType, T.ArrayType) else c.cast("string")
        return F.when(F.coalesce(text, F.lit("")) == "", " ").otherwise(text).alias(f.name)
    return df.select(*[cell(f) for f in df.schema.fields])


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Several results as one folder of CSV folders."""
    for name, df in tables.items():
        flatten_for_export(df).write.csv(f"{path}/{name}", header=True)


def confusion_matrix(confusion: DataFrame, labels: list) -> DataFrame:
    """Wide, row-normalised confusion table."""
    return confusion.groupBy("cls").pivot("predicted", labels).agg(F.first("share")).na.fill(0.0)


def write_confusion(confusion: DataFrame, labels: list, path: str) -> None:
    confusion_matrix(confusion, labels).write.csv(path, sep="\t", header=True)


def write_by_category(slim: DataFrame, path: str) -> None:
    """Terms split into one folder per category."""
    slim.write.partitionBy("category").parquet(path)
