"""Two-component mixtures per gene, bimodality, thresholds and power transforms."""

from __future__ import annotations

import functools
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.functions.scalars import boxcox_value
from strandframe.functions.special import chi2_sf, erfc
from strandframe.session import cut_lineage, fits_broadcast, spread


def _pdf(x: Column, m: Column, s: Column) -> Column:
    z = (x - m) / s
    return F.exp(-0.5 * z * z) / (s * math.sqrt(2 * math.pi))


#: Most values of a gene that are one array; a gene of more is spread over several.
CHUNK = 1 << 20
#: Values taken at once, so that what a round holds of them stays in the processor's cache.
_SLICE = 1 << 12
_THETA = ["w1", "m1", "m2", "s1", "s2"]


def _value_chunks(expr: DataFrame) -> DataFrame:
    """(gene, chunks, values): the non-null values of each gene in arrays of bounded size."""
    data = expr.select("gene", F.col("value").cast("double").alias("value")).filter("value IS NOT NULL").withColumn("_i", F.monotonically_increasing_id())
    sizes = data.groupBy("gene").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("chunks"))
    return data.join(sizes, "gene").groupBy("gene", "chunks", F.pmod("_i", "chunks").alias("chunk")).agg(F.collect_list("value").alias("values")).drop("chunk")


def _em_sums(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """What the next parameters of a gene need from some of its values, and their log-likelihood.

    Values count from the middle of the two means, which keeps the sums of squares exact.
    """
    w, m1, m2, s1, s2 = theta
    total = np.zeros(6)
    for lo in range(0, len(x), _SLICE):
        some = x[lo:lo + _SLICE]
        l1 = math.log(w) - math.log(s1) - 0.5 * ((some - m1) / s1) ** 2
        l2 = math.log1p(-w) - math.log(s2) - 0.5 * ((some - m2) / s2) ** 2
        less = np.exp(-np.abs(l2 - l1))  # of the two densities, the lower over the higher
        r, d = np.where(l2 <= l1, 1.0, less) / (1 + less), some - (m1 + m2) / 2
        rd = r * d
        total += [r.sum(), rd.sum(), rd @ d, d.sum(), d @ d, (np.maximum(l1, l2) + np.log1p(less)).sum()]
    total[5] -= len(x) * 0.5 * math.log(2 * math.pi)
    return np.array([len(x), *total])


def _em_next(sums: np.ndarray, theta: np.ndarray, floor: float) -> np.ndarray:
    """The parameters after ``theta``; weights stay inside (0, 1) and deviations at ``floor`` or more."""
    n, a, ad, add, d, dd, _ = sums
    a = min(max(a, 1e-9 * n), n * (1 - 1e-9))
    middle, d1, d2 = (theta[1] + theta[2]) / 2, ad / a, (d - ad) / (n - a)
    s1, s2 = math.sqrt(max(add / a - d1 * d1, 0.0)), math.sqrt(max((dd - add) / (n - a) - d2 * d2, 0.0))
    return np.array([a / n, middle + d1, middle + d2, max(s1, floor), max(s2, floor)])


def _free(theta: np.ndarray) -> np.ndarray:
    """Parameters without bounds: log odds of the weight, means, logs of the deviations."""
    w, m1, m2, s1, s2 = theta
    return np.array([math.log(w) - math.log1p(-w), m1, m2, math.log(s1), math.log(s2)])


def _squared_step(zero: np.ndarray, one: np.ndarray, two: np.ndarray, floor: float, reach: float) -> tuple[np.ndarray, float]:
    """Where three successive parameters point: a step of squared length along their first and second differences.

    Its length, returned too, is at most ``reach`` times that of a plain round.
    """
    a, b, c = _free(zero), _free(one), _free(two)
    r, v = b - a, c - 2 * b + a
    bend = float(np.sqrt(v @ v))
    k = reach if not bend else min(max(float(np.sqrt(r @ r)) / bend, 1.0), reach)
    w, m1, m2, s1, s2 = a + 2 * k * r + k * k * v
    w = 1 / (1 + math.exp(-min(max(w, -20.0), 20.0)))
    return np.array([w, m1, m2, max(math.exp(min(s1, 300.0)), floor), max(math.exp(min(s2, 300.0)), floor)]), k


class _Fit:
    """Where the fit of one gene stands. ``ask`` are the parameters whose sums it needs next; ``tell`` takes them."""

    def __init__(self, theta, percent: float | None, tol: float, floor: float):
        self.percent, self.tol, self.floor = percent, tol, floor
        self.ask, self.kept, self.loglik, self.rounds, self.settled, self.phase, self.trail = np.asarray(theta, float), None, None, 0, False, 0, []
        self.reach = 4.0  # of the squared step: longer after one that went all the way, shorter after one that failed

    def state(self) -> dict:
        return {k: getattr(self, k) for k in ("ask", "kept", "loglik", "rounds", "settled", "phase", "trail", "reach", "floor")}

    def tell(self, sums: np.ndarray) -> None:
        theta, loglik, after = self.ask, float(sums[-1]), _em_next(sums, self.ask, self.floor)
        self.rounds += 1
        if self.percent is not None:  # plain rounds until the log-likelihood rises by few percent
            before, self.kept, self.loglik = self.loglik, theta, loglik
            self.settled = before is not None and abs(100 * (loglik - before)) <= self.percent * abs(before)
            self.ask = after
            return
        if self.phase == 2:  # the far point: taken unless it is worse than the one before it
            _, two, least, length = self.trail
            good = loglik >= least
            self.ask, self.phase = (after if good else two), 0
            if not good:
                self.reach = max(self.reach / 4, 1.0)
            elif length == self.reach:
                self.reach *= 4
            return
        if self.phase == 0:
            self.kept, self.loglik = theta, loglik
            width = math.sqrt(max(sums[5] / sums[0] - (sums[4] / sums[0]) ** 2, self.floor**2))
            change = np.abs(after - theta) / np.array([1, width, width, width, width])
            self.settled = bool(change.max() <= self.tol)
            self.trail, self.ask, self.phase = [theta, after], after, 1
            return
        self.ask, length = _squared_step(self.trail[0], theta, after, self.floor, self.reach)
        self.trail, self.phase = [theta, after, loglik, length], 2


_RESULT = "gene string, w1 double, w2 double, m1 double, m2 double, s1 double, s2 double, loglik double, rounds int, settled boolean"


def _row(gene, fit: _Fit) -> tuple:
    w, m1, m2, s1, s2 = (float(v) for v in fit.kept)
    low = (w, 1 - w, m1, m2, s1, s2) if m1 <= m2 else (1 - w, w, m2, m1, s2, s1)
    return gene, *low, fit.loglik, fit.rounds, fit.settled


def fit_gmm2(expr: DataFrame, percent: float | None = None, tol: float = 1e-5, floor: float = 0.01, max_rounds: int = 20_000) -> DataFrame:
    """Mixture of two normals for every gene: (gene, w1, w2, m1, m2, s1, s2, loglik, rounds, settled), m1 <= m2.

    Rounds of expectation and maximisation from the quartiles. With ``percent`` they are plain and
    end when the log-likelihood changes by at most that many percent. Without, every two rounds are
    extended by a squared step (taken when it is no worse), and a gene ends when a plain round moves its weight, means and
    deviations by at most ``tol``, the latter in standard deviations of the gene. ``settled`` says whether that came
    within ``max_rounds``. No component gets narrower than ``floor`` standard deviations of the gene, as
    one that closes in on a single value would have no bound on its likelihood.

    A gene of up to ``CHUNK`` values is one array and fitted where it lies, all of them in one job. The
    arrays of a larger gene are summed up in their tasks, a job for each round, until all such genes have ended.
    Genes without a value are left out; one of equal values has deviations 1e-9.
    """
    chunks = cut_lineage(_value_chunks(expr))
    start = expr.filter("value IS NOT NULL").groupBy("gene").agg(
        F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.75)), 10000).alias("_q"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("_sd"))
    start = cut_lineage(start.select("gene", F.col("_q")[0].cast("double").alias("low"), F.col("_q")[1].cast("double").alias("high"), "_sd"))

    def begun(low, high, sd) -> _Fit:
        least = max(floor * sd, 1e-9)
        return _Fit([0.5, low, high, max(sd / 2, least), max(sd / 2, least)], percent, tol, least)

    def fit_here(batches):
        for rows in batches:
            out = []
            for gene, values, low, high, sd in rows[["gene", "values", "low", "high", "_sd"]].itertuples(index=False):
                fit, x = begun(low, high, sd), np.asarray(values, float)
                while not fit.settled and fit.rounds < max_rounds:
                    fit.tell(_em_sums(x, fit.ask))
                out.append(_row(gene, fit))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    small = spread(chunks.filter("chunks = 1")).join(F.broadcast(start) if fits_broadcast(start) else start, "gene").mapInPandas(fit_here, _RESULT)
    large = chunks.filter("chunks > 1")
    if not large.limit(1).count():
        return small
    return small.unionByName(_fit_apart(large, start, begun, max_rounds))


def _fit_apart(chunks: DataFrame, start: DataFrame, begun, max_rounds: int) -> DataFrame:
    """Fits of genes in several arrays, a round a job; a gene takes part until it has ended. The fits travel as rows."""
    pack = "gene string, w1 double, m1 double, m2 double, s1 double, s2 double, going boolean, fit binary"

    def packed(rows) -> pd.DataFrame:
        out = [(gene, *(float(v) for v in fit.ask), not fit.settled and fit.rounds < max_rounds, pickle.dumps(fit.state())) for gene, fit in rows]
        return pd.DataFrame(out, columns=[c.split()[0] for c in pack.split(", ")])

    def opened(state: bytes) -> _Fit:
        fit = begun(0.0, 0.0, 1.0)
        for k, v in pickle.loads(bytes(state)).items():
            setattr(fit, k, v)
        return fit

    def first(batches):
        for rows in batches:
            yield packed((g, begun(a, b, sd)) for g, a, b, sd in rows[["gene", "low", "high", "_sd"]].itertuples(index=False))

    def sums(batches):
        for rows in batches:
            found = [(g, *_em_sums(np.asarray(x, float), np.array(t))) for g, x, *t in rows[["gene", "values", *_THETA]].itertuples(index=False)]
            yield pd.DataFrame(found, columns=["gene", *[f"x{k}" for k in range(7)]])

    def told(batches):
        for rows in batches:
            out = []
            for gene, state, *x in rows[["gene", "fit", *[f"x{k}" for k in range(7)]]].itertuples(index=False):
                fit = opened(state)
                fit.tell(np.array(x))
                out.append((gene, fit))
            yield packed(out)

    def read(batches):
        for rows in batches:
            yield pd.DataFrame([_row(g, opened(f)) for g, f in zip(rows["gene"], rows["fit"])], columns=[c.split()[0] for c in _RESULT.split(", ")])

    fits = cut_lineage(start.join(chunks.select("gene").distinct(), "gene", "left_semi").mapInPandas(first, pack))
    ended = []
    while fits.limit(1).count():
        parts = chunks.select("gene", "values").join(fits.select("gene", *_THETA), "gene").mapInPandas(sums, "gene string, " + ", ".join(f"x{k} double" for k in range(7)))
        total = parts.groupBy("gene").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(7)])
        after = cut_lineage(total.join(fits.select("gene", "fit"), "gene").mapInPandas(told, pack))
        fits = after.filter("going")
        if after.filter("not going").limit(1).count():
            ended.append(after.filter("not going"))
    return functools.reduce(DataFrame.unionByName, ended).mapInPandas(read, _RESULT)


def mixture_loglik(expr: DataFrame, gmm: DataFrame) -> DataFrame:
    """Exact log-likelihood of each gene under its mixture."""
    x = F.col("value")
    density = F.col("w1") * _pdf(x, F.col("m1"), F.col("s1")) + F.col("w2") * _pdf(x, F.col("m2"), F.col("s2"))
    return expr.select("gene", "value").join(gmm.select("gene", "w1", "w2", "m1", "m2", "s1", "s2"), "gene").groupBy("gene").agg(
        F.sum(F.log(F.greatest(density, F.lit(1e-300)))).alias("loglik"))


def bimodality(expr: DataFrame, gmm: DataFrame, alpha: float = 0.05, df: int = 6) -> DataFrame:
    """Likelihood-ratio test of one normal against the mixture."""
    n, s = F.count("value"), F.stddev_pop("value")
    one = expr.groupBy("gene").agg((-0.5 * n * (math.log(2 * math.pi) + 1) - n * F.log(s)).alias("_one"))
    out = one.join(gmm.select("gene", "loglik"), "gene").withColumn("lr", 2 * (F.col("loglik") - F.col("_one")))
    return out.withColumn("p", chi2_sf("lr", df)).select("gene", "lr", "p", (F.col("p") <= alpha).alias("bimodal"))


def gmm_threshold(gmm: DataFrame) -> DataFrame:
    """Where the lower component stops being the likelier one between the means, and the tail areas there.

    With x = midpoint + u * half distance the log ratio of the weighted densities is a quadratic in u
    that falls all the way from u = -1 (lower mean) to u = 1 (upper mean). So it has one root there
    if it changes sign, and none otherwise (all three results are NULL then). ``area1`` is the lower
    component's mass above the threshold, ``area2`` the upper one's below it.
    """
    half = (F.col("m2") - F.col("m1")) / 2
    p, q = half / F.col("s1"), half / F.col("s2")  # half distance in units of each deviation
    log_odds = F.log(F.col("w1") * F.col("s2") / (F.col("w2") * F.col("s1")))
    g = gmm.select("gene", "m1", "m2", half.alias("_half"), p.alias("_p"), q.alias("_q"), log_odds.alias("_odds"))
    p, q, odds = F.col("_p"), F.col("_q"), F.col("_odds")
    bend, slope = (q * q - p * p) / 2, p * p + q * q
    level = bend + odds  # at the midpoint
    crosses = (odds + 2 * q * q >= 0) & (odds - 2 * p * p <= 0) & (slope > 0)
    root = 2 * level / F.nullif(slope + F.sqrt(F.greatest(slope * slope - 4 * bend * level, F.lit(0.0))), F.lit(0.0))
    u = F.col("_u")

    def above(deviations: Column) -> Column:
        return 0.5 * erfc(deviations / math.sqrt(2))

    return g.withColumn("_u", F.when(crosses, root)).select(
        "gene", ((F.col("m1") + F.col("m2")) / 2 + u * F.col("_half")).alias("threshold"),
        above(p * (1 + u)).alias("area1"), above(q * (1 - u)).alias("area2"))


def _boxcox_loglik(rows: DataFrame) -> DataFrame:
    """Profile log-likelihood of each (gene, lam)."""
    y = boxcox_value("value", "lam")
    return rows.groupBy("gene", "lam").agg(
        (-F.count("*") / 2 * F.log(F.var_pop(y)) + (F.first("lam") - 1) * F.sum(F.log("value"))).alias("loglik"))


def boxcox(expr: DataFrame, low: float = -2.0, high: float = 2.0, step: float = 0.1, fine: int = 10) -> DataFrame:
    """Power of each gene's transform by likelihood on a grid, refined around its best point."""
    n = int(round((high - low) / step))
    coarse = F.array(*[F.lit(round(low + i * step, 10)) for i in range(n + 1)])
    base = expr.select("gene", "value").filter("value > 0")
    first = _boxcox_loglik(base.withColumn("lam", F.explode(coarse))).groupBy("gene").agg(F.max_by("lam", "loglik").alias("_l"))
    around = F.transform(F.sequence(F.lit(-fine), F.lit(fine)), lambda i: F.round(F.col("_l") + i * (step / fine), 10))
    second = _boxcox_loglik(base.join(first, "gene").withColumn("lam", F.explode(around)))
    return second.groupBy("gene").agg(F.max_by("lam", "loglik").alias("lam"), F.max("loglik").alias("loglik"))
