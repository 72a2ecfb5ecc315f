"""Patient timelines ``(pat, week, kind, val)``: coverage, interpolation, responder rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.operators.aggregates import avg_duplicates
from strandframe.operators.joins import asof_pair, took
from strandframe.operators.ordered import ordered_scan, union_all

WINDOW_TIMES = [0, 2, 4, 8, 12, 24]


def timeline(measures: dict[str, DataFrame]) -> DataFrame:
    """Measurements of several kinds in one table."""
    return union_all([df.select("pat", "week", F.lit(kind).alias("kind"), F.col("val").cast("double").alias("val")) for kind, df in measures.items()])


def covers(tl: DataFrame, start: float, stop: float, kinds: list[str]) -> DataFrame:
    """Patients whose readings of every kind span the window."""
    spans = tl.filter(F.col("kind").isin(*kinds)).groupBy("pat", "kind").agg(F.min("week").alias("_lo"), F.max("week").alias("_hi"))
    return spans.filter((F.col("_lo") <= start) & (F.col("_hi") >= stop)).groupBy("pat").agg(F.count("*").alias("_k")).filter(
        F.col("_k") == len(kinds)).select("pat")


def value_at(tl: DataFrame, times: list[int], keys: list[str] = ["pat", "kind"], span: float = 512.0) -> DataFrame:
    """Linear value at each time, NULL outside the observed range; readings of one week are averaged."""
    around = asof_pair(avg_duplicates(tl, keys), times, keys, span=span)
    share = (F.col("time") - F.col("prev_week")) / F.nullif(F.col("next_week") - F.col("prev_week"), F.lit(0))
    lerp = F.col("prev_val") + (F.col("next_val") - F.col("prev_val")) * F.coalesce(share, F.lit(0.0))
    inside = F.col("prev_week").isNotNull() & F.col("next_week").isNotNull()
    return around.select(*keys, "time", F.when(inside, lerp).alias("val"))


def _wide(values: DataFrame, times: list[int], keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(*[F.max(F.when(F.col("time") == t, F.col("val"))).alias(f"t{t}") for t in times])


def trend(tl: DataFrame, keys: list[str] = ["pat", "kind"], span: float = 512.0) -> DataFrame:
    """Change and slope to the previous reading: (…, change, slope). One reading per week expected."""
    prev = F.struct(F.col("week").alias("w"), F.col("val").alias("v"))
    out = ordered_scan(tl, keys, "week", [("_p", "last_before", prev)], span)
    change = F.col("val") - F.col("_p.v")
    return out.withColumn("change", change).withColumn("slope", change / (F.col("week") - F.col("_p.w"))).drop("_p")


def responder_sd(tl: DataFrame, kind: str, cut: float = 0.01, floor: bool = False) -> DataFrame:
    """Value at week 8 below ``cut`` of the value at week 0; ``floor`` rounds the ratio down first."""
    v = _wide(value_at(tl.filter(F.col("kind") == kind), [0, 8]), [0, 8], ["pat"])
    ratio = F.col("t8") / F.nullif(F.col("t0"), F.lit(0.0))
    return v.select("pat", ((F.floor(ratio) if floor else ratio) < cut).alias("responder"))


def _steps(times: list[int]) -> list[Column]:
    return [F.col(f"t{b}") - F.col(f"t{a}") for a, b in zip(times, times[1:])]


def responder_wnd(tl: DataFrame, kind: str, times: list[int] = WINDOW_TIMES, need: int = 3) -> DataFrame:
    """More than ``need`` steps of the evaluation grid that do not rise."""
    v = _wide(value_at(tl.filter(F.col("kind") == kind), times), times, ["pat"])
    calm = sum((F.coalesce(d <= 0, F.lit(False)).cast("int") for d in _steps(times)), F.lit(0))
    return v.select("pat", calm.alias("n_steps"), (calm > need).alias("responder"))


def responder_drop(tl: DataFrame, kind: str, drop: float = 1.5, by: int = 8, spline: bool = False) -> DataFrame:
    """A fall of at least ``drop`` from week 0 to week ``by``; fewer than three times is no response."""
    one = tl.filter(F.col("kind") == kind)
    seen = one.groupBy("pat").agg(F.countDistinct("week").alias("_n"))
    values = spline_at(one, [0, by]) if spline else value_at(one, [0, by])
    v = _wide(values, [0, by], ["pat"]).join(seen, "pat")
    fell = F.coalesce(F.col(f"t{by}") - F.col("t0") <= -drop, F.lit(False))
    return v.select("pat", (fell & (F.col("_n") >= 3)).alias("responder"))


def responder_share(tl: DataFrame, kind: str, times: list[int], share: float = 0.4, max_missing: float = 0.8,
                    direction: str = "falling") -> DataFrame:
    """Enough steps in the wanted direction and not too many unknown ones."""
    v = _wide(value_at(tl.filter(F.col("kind") == kind), times), times, ["pat"])
    steps = _steps(times)
    good = [F.coalesce((d < 0) if direction == "falling" else (d > 0), F.lit(False)).cast("int") for d in steps]
    gone = [d.isNull().cast("int") for d in steps]
    n = float(len(steps))
    moved, unknown = sum(good, F.lit(0)) / n, sum(gone, F.lit(0)) / n
    return v.select("pat", moved.alias("share"), ((moved >= share) & (unknown < max_missing)).alias("responder"))


def spline_through(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through the points with not-a-knot ends, NaN outside their range.

    The first two pieces are one cubic, and so are the last two; three points give a parabola.
    Fewer than three points give NaN everywhere.
    """
    n = len(x)
    out = np.full(len(at), np.nan)
    if n < 3:
        return out
    inside = (at >= x[0]) & (at <= x[-1])
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    if n == 3:
        second = np.full(3, 2 * (slope[1] - slope[0]) / (h[0] + h[1]))
    else:
        a, b = np.zeros((n, n)), np.zeros(n)
        inner = np.arange(1, n - 1)
        a[inner, inner - 1], a[inner, inner], a[inner, inner + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
        b[1:-1] = 6 * np.diff(slope)
        a[0, :3] = h[1], -(h[0] + h[1]), h[0]
        a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        second = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at[inside], "right") - 1, 0, n - 2)
    t, hi = at[inside] - x[i], h[i]
    u = hi - t
    out[inside] = (
        second[i] * u**3 / (6 * hi) + second[i + 1] * t**3 / (6 * hi)
        + (y[i] / hi - second[i] * hi / 6) * u + (y[i + 1] / hi - second[i + 1] * hi / 6) * t)
    return out


def spline_at(tl: DataFrame, times: list[int], keys: list[str] = ["pat", "kind"]) -> DataFrame:
    """Spline value at each time. A group is one patient's weekly means, at most one row per study week."""
    weekly = avg_duplicates(tl, keys).select(*keys, "week", "val")
    fields = ", ".join(f"{k} {weekly.schema[k].dataType.simpleString()}" for k in keys)
    at = np.array(times, dtype=float)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        v = spline_through(pdf["week"].to_numpy(float), pdf["val"].to_numpy(float), at)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(at) for k in keys}, "time": times, "val": v})

    out = weekly.groupBy(*keys).applyInPandas(fit, f"{fields}, time int, val double")
    return out.withColumn("val", F.nanvl("val", F.lit(None)))


def normalise(tl: DataFrame, times: list[int], spline: bool = False) -> DataFrame:
    """All readings on a common time grid, negative values set to NULL."""
    v = spline_at(tl, times) if spline else value_at(tl, times)
    return v.withColumn("val", F.when(F.col("val") >= 0, F.col("val")))


def took_drugs(regimen: DataFrame, wanted: list[str]) -> DataFrame:
    """Patients on all wanted drugs in a regimen that starts on day 0."""
    return took(regimen.filter(F.col("start") == 0), wanted).select("pat").distinct()


def group_hist(norm: DataFrame, groups: DataFrame, bins: int = 15, low: float = 0.0, high: float = 14.5,
               value: str = "val") -> DataFrame:
    """Share of each group's patients per time and value bin."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("_size"))
    rows = norm.filter(F.col(value).isNotNull()).join(groups, "pat")
    binned = rows.withColumn("bin", F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int"))
    counts = binned.groupBy("grp", "time", "bin").agg(F.count("*").alias("n"))
    return counts.join(sizes, "grp").select("grp", "time", "bin", "n", (F.col("n") / F.col("_size")).alias("share"))


def usable(norm: DataFrame, max_missing: int = 4) -> DataFrame:
    """Patients with at most ``max_missing`` unknown grid times."""
    return norm.groupBy("pat").agg(F.sum(F.col("val").isNull().cast("int")).alias("n_missing")).filter(F.col("n_missing") <= max_missing)


def split_groups(patients: DataFrame, responders: DataFrame, path: str) -> None:
    """Patients written to one folder per responder group."""
    patients.join(responders.select("pat", "responder"), "pat").write.partitionBy("responder").parquet(path)
