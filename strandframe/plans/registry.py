"""Registered queries and, where SQL can say it, their oracle."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MODULES = ("lists", "motifs", "variants", "statistics", "clinical", "models", "sources")


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"strandframe.plans.{m}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
