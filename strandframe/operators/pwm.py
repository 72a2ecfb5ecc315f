"""Position weight matrices as long tables ``(pwm_id, offset, symbol, weight)``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandframe.functions.scalars import chunks
from strandframe.operators.joins import pair_all, range_join
from strandframe.operators.ordered import ordered_scan, value_span
from strandframe.operators.motifs import STEP
from strandframe.session import cut_lineage

#: Symbol whose weight applies to letters a position does not list.
OTHER = "*"


def pwm_from_seqs(aligned: DataFrame, key: str = "pwm_id", seq: str = "seq") -> DataFrame:
    """Letter shares per column of aligned sequences."""
    texts = cut_lineage(aligned.groupBy(key, seq).agg(F.count("*").alias("_n")))  # the rows are read once, equal ones count together
    letters = texts.select(key, "_n", F.posexplode(F.split(seq, "")).alias("offset", "symbol"))
    counts = letters.groupBy(key, "offset", "symbol").agg(F.sum("_n").alias("n"))
    totals = texts.groupBy(key).agg(F.sum("_n").alias("_total"))
    return counts.join(totals, key).select(key, "offset", "symbol", (F.col("n") / F.col("_total")).alias("weight"))


def _positions(parsed, alphabet: str) -> list[set[str]]:
    """Allowed letters at each position of a parsed pattern."""
    out: list[set[str]] = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(arg)})
        elif name == "NOT_LITERAL":
            out.append(set(alphabet) - {chr(arg)})
        elif name == "ANY":
            out.append(set(alphabet))
        elif name == "IN":
            letters, negated = set(), False
            for kind, value in arg:
                if str(kind) == "NEGATE":
                    negated = True
                elif str(kind) == "RANGE":
                    letters |= {chr(c) for c in range(value[0], value[1] + 1)}
                elif str(kind) == "LITERAL":
                    letters.add(chr(value))
            out.append(set(alphabet) - letters if negated else letters)
        elif name == "SUBPATTERN":
            out.extend(_positions(arg[-1], alphabet))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            times = high if isinstance(high, int) and high < 64 else max(int(low), 1)
            out.extend(_positions(body, alphabet) * times)
        elif name == "BRANCH":
            options = [_positions(o, alphabet) for o in arg[1]]
            for i in range(max(map(len, options))):
                out.append(set().union(*[o[i] for o in options if i < len(o)]))
    return out


def pwm_from_regex(spark: SparkSession, motifs: list[tuple[str, str]], alphabet: str) -> DataFrame:
    """Even weights over the letters a pattern allows at each position (classes, branches, negation, wildcard)."""
    rows = []
    for name, regex in motifs:
        for offset, letters in enumerate(_positions(re._parser.parse(regex), alphabet)):
            rows += [(name, offset, s, 1.0 / len(letters)) for s in sorted(letters)]
    return spark.createDataFrame(rows, "pwm_id string, offset int, symbol string, weight double")


def _packed(pwm: DataFrame) -> DataFrame:
    """One row per matrix: an array of symbol → weight maps, by offset."""
    entries = pwm.groupBy("pwm_id").agg(
        F.collect_list(F.struct("offset", "symbol", "weight")).alias("_e"), F.max("offset").alias("_last"))
    maps = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda o: F.map_from_entries(F.transform(
        F.filter("_e", lambda e: e["offset"] == o), lambda e: F.struct(e["symbol"], e["weight"]))))
    return entries.select("pwm_id", maps.alias("_maps"))


def pwm_scan(seqs: DataFrame, pwm: DataFrame, missing: float | str | None = None, seq: str = "seq", hits: DataFrame | None = None) -> DataFrame:
    """Score of every placement: (ids…, pwm_id, start, score).

    A letter without a weight makes the score NULL, counts as the number ``missing``, or
    with ``missing='position'`` takes the weight of the position's ``*`` symbol. With ``hits(seq_id, motif, start)``
    a column ``hit`` says whether the motif of the matrix's name has one there: hits meet pieces of text, not placements.
    """
    keep = [c for c in seqs.columns if c != seq]
    widest = pwm.agg(F.max("offset")).first()[0] + 1
    pieces = seqs.select(*keep, F.posexplode(chunks(seq, STEP, widest - 1)).alias("_part", "_text"))
    marks, marked, hit = [], [], []
    if hits is not None:
        at = hits.filter("motif IS NOT NULL").groupBy("seq_id", F.floor(F.col("start") / STEP).cast("int").alias("_part"), "motif").agg(
            F.collect_set(F.pmod("start", F.lit(STEP)).cast("int")).alias("_at"))
        by_piece = at.groupBy("seq_id", "_part").agg(F.map_from_entries(F.collect_list(F.struct("motif", "_at"))).alias("_marks"))
        pieces = pieces.join(by_piece, ["seq_id", "_part"], "left")
        marks, marked = ["_marks"], [F.try_element_at("_marks", F.col("pwm_id")).alias("_at")]
        hit = [F.coalesce(F.array_contains("_at", F.col("_s")), F.lit(False)).alias("hit")]
    letters = pieces.select(*keep, "_part", *marks, F.split("_text", "").alias("_letters"))
    paired = pair_all(_packed(pwm), letters).withColumn("_w", F.size("_maps"))
    last = F.least(F.lit(STEP), F.size("_letters") - F.col("_w") + 1)
    rows = paired.select(*keep, "pwm_id", "_part", "_letters", "_maps", "_w", *marked,
                         F.explode(F.when(last >= 1, F.sequence(F.lit(0), last - 1))).alias("_s"))

    def weight(j: int):
        row = F.get("_maps", F.lit(j))
        found = F.try_element_at(row, F.get("_letters", F.col("_s") + j))
        if missing == "position":
            found = F.coalesce(found, F.try_element_at(row, F.lit(OTHER)))
        elif missing is not None:
            found = F.coalesce(found, F.lit(float(missing)))
        return F.when(F.lit(j) < F.col("_w"), found).otherwise(0.0)

    score = weight(0)
    for j in range(1, widest):
        score = score + weight(j)
    start = (F.col("_part") * STEP + F.col("_s")).cast("int")
    return rows.select(*keep, "pwm_id", start.alias("start"), score.alias("score"), *hit)


def map_symbols(seqs: DataFrame, table: dict[str, str], seq: str = "seq") -> DataFrame:
    """Sequence letters replaced by the symbols a matrix uses (one letter each), others kept."""
    return seqs.withColumn(seq, F.translate(seq, "".join(table), "".join(table.values())))


def pwm_best(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Best placement per key (the first of equals).

    Placements are first condensed to the first one of each score: plain values are aggregated by hash, a pair of
    values only after a sort.
    """
    firsts = scores.groupBy(*keys, "pwm_id", "score").agg(F.min("start").alias("start"))
    top = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("start")).alias("neg"))))
    return firsts.groupBy(*keys, "pwm_id").agg(top.alias("_b")).select(
        *keys, "pwm_id", F.col("_b.score").alias("score"), (-F.col("_b.neg")).alias("start"))


def empirical_p(scores: DataFrame, null: DataFrame, key: str = "pwm_id", times: str | None = None) -> DataFrame:
    """Share of null scores above each score, never below 1/n.

    Both tables are condensed to distinct scores and counted on one axis. A null row counts once, or ``times`` times.
    """
    counts = cut_lineage(null.groupBy(key, "score").agg((F.sum(times) if times else F.count("*")).alias("_n")))
    asked = scores.select(key, "score").distinct().withColumn("_n", F.lit(0).cast("long"))
    axis = counts.unionByName(asked).groupBy(key, "score").agg(F.sum("_n").alias("_n"))
    running = ordered_scan(axis, [key], "score", [("_upto", "sum", F.col("_n"))], value_span(axis, "score"))
    totals = counts.groupBy(key).agg(F.sum("_n").alias("_total"))
    p = running.join(totals, key).select(
        key, "score", F.greatest((F.col("_total") - F.col("_upto")) / F.col("_total"), 1 / F.col("_total")).alias("p"))
    return scores.join(p, [key, "score"])


def pwm_binned_max(scores: DataFrame, bins: DataFrame) -> DataFrame:
    """Highest score per sequence and bin of the matrix's motif."""
    s = scores.withColumnRenamed("pwm_id", "motif")
    return range_join(s, bins, ["motif"], "start", "lo", "hi").groupBy("seq_id", "motif", "bin_id").agg(F.max("score").alias("score"))


def pwm_objective(scores: DataFrame) -> DataFrame:
    """Mean score off the motif's hits over mean score on them; lower separates better. ``scores`` is a scan with hits."""
    off = F.avg(F.when(~F.col("hit"), F.col("score")))
    on = F.avg(F.when(F.col("hit"), F.col("score")))
    return scores.groupBy("pwm_id").agg((off / on).alias("ratio"))
