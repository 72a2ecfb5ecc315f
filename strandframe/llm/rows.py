"""Whole input rows carried as one column, so that no working column can clash with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pack(df: DataFrame, **working: Column) -> DataFrame:
    """The columns ``working`` and the input row as struct ``row``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in working.items()])


def unpack(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The input's ``columns`` followed by ``new`` ones, which replace those of their name."""
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns if c not in new], *[c.alias(n) for n, c in new.items()])
