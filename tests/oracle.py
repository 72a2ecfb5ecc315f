"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    rel = con.sql(sql)
    ocols, obag = _bag(rel.columns, rel.fetchall())
    scols, sbag = _bag(df.columns, [tuple(r) for r in df.collect()])
    if ocols != scols:
        return f"columns {scols} vs {ocols}"
    if obag != sbag:
        only_s, only_o = list((sbag - obag).items())[:3], list((obag - sbag).items())[:3]
        return f"rows {sum(sbag.values())} vs {sum(obag.values())}; spark {only_s}; sql {only_o}"
    return None
