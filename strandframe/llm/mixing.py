"""Mixing by iterative proportional fitting: token weights raked to three sets of target shares."""

from __future__ import annotations

import functools
import warnings

from pyspark.sql import Column, DataFrame, functions as F

from strandframe.llm.rows import pack, unpack
from strandframe.session import cut_lineage, maybe_broadcast

#: Topic rules in order; a text has the first topic whose characters make up the share.
TOPIC_RULES = (("markup", r"[#$%&*|<>=]", 0.02), ("shout", r"!", 0.02), ("figures", r"[0-9]", 0.02))
MARGINS = ("source", "lang", "topic")
#: Target share of a value is its token share to this power, rescaled; 1 keeps the mix, 0 makes it even.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, rules=TOPIC_RULES) -> Column:
    """First rule whose pattern's matches reach its share of all characters, else ``prose``."""
    size = F.length(text)
    out = F.lit("prose")
    for name, pattern, share in reversed(rules):
        hit = F.regexp_count(text, F.lit(pattern)) >= size * F.lit(share)
        out = F.when((size > 0) & hit, F.lit(name)).otherwise(out)
    return out


def _label(c: str) -> Column:
    """Null is a value of its own, apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    n = cells.groupBy(margin).agg(F.pow(F.sum("n"), F.lit(power)).alias("_p"))
    return n.select(margin, (F.col("_p") / F.lit(n.agg(F.sum("_p")).first()[0])).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tol: float = 1e-9, max_rounds: int = 200, settle: bool = False):
    """Weights ``w`` for ``cells`` (label columns, ``n``) whose shares meet ``targets`` (label, ``share``).

    One round scales the weights to each margin in turn. Rounds go on until no factor of a round is
    further than ``tol`` from 1, so that all targets are met. Targets that contradict the zero cells have no
    solution; then a RuntimeError says how far off the last round was. With ``settle`` such rounds go on until
    one leaves every weight as it was (within ``tol`` of itself, or below 1e-15 of all), at most ``max_rounds``,
    and a warning says by how much weights still moved if that did not come; the last margin is met in either
    case and ``margin_gaps`` has what the others lack. Returns (cells, rounds).
    """
    cells = cut_lineage(cells.filter("n > 0").withColumn("w", F.col("n").cast("double")))
    targets = {m: maybe_broadcast(cut_lineage(t)) for m, t in targets.items()}
    off = None
    for k in range(max_rounds):
        now = cells.withColumn("_off", F.lit(0.0)).withColumn("_old", F.col("w"))
        for m, share in targets.items():
            scale = now.groupBy(m).agg(F.sum("w").alias("_sum")).join(share, m).select(
                m, (F.col("share") / F.col("_sum")).alias("_scale"))
            now = now.join(scale, m).withColumn("w", F.col("w") * F.col("_scale")).withColumn(
                "_off", F.greatest("_off", F.abs(F.col("_scale") - 1))).drop("_scale")
        now = cut_lineage(now)
        moves = F.when(F.col("w") < 1e-15, 0.0).otherwise(F.abs(F.col("w") - F.col("_old")) / F.col("w"))
        off, moved = now.agg(F.max("_off"), F.max(moves)).first()
        cells = now.drop("_off", "_old")
        if off is None or off <= tol or settle and moved <= tol:
            return cells, k + 1
    if settle:
        warnings.warn(f"weights still move by a share of {moved:.3g} after {max_rounds} rounds of raking; their shares are those of the last round")
        return cells, max_rounds
    raise RuntimeError(f"no weights meet all targets: after {max_rounds} rounds they are still off by {off}")


def margin_gaps(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Per value of each margin (``margin``, ``value``): its ``share`` of the weights, its ``target`` and their ``gap``."""
    parts = []
    for m, share in targets.items():
        now = cells.groupBy(m).agg(F.sum("w").alias("_sum")).join(share, m)
        parts.append(now.select(F.lit(m).alias("margin"), F.col(m).alias("value"), F.col("_sum").alias("share"),
                                F.col("share").alias("target"), (F.col("_sum") - F.col("share")).alias("gap")))
    return functools.reduce(DataFrame.unionByName, parts)


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5; the same for equal keys anywhere."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    temper: dict[str, float] | None = None, tol: float = 1e-9,
) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, ``weight``, ``probability``, ``sampled`` and ``gap``.

    ``weight`` is the raked weight of one token of the document's (source, lang, topic) cell against
    its weight in the corpus; ``probability`` is that divided by the largest one, so that every
    margin of the expected sample has its target share without any probability being cut at 1.
    A document is sampled when a number drawn from its id lies below its probability.

    Targets can contradict the empty cells (a source that alone has its language, and no other, would need
    two shares at once). Then the weights are those of the raking's fixed cycle, which ends on the topics: topics
    have their targets, sources and languages come near theirs, and a warning names the largest gap. The
    gaps of the document's values are in ``gap`` (share less target, 0 when met; null without a word).

    Null labels are a value of their own; a document without a word has no weight and probability 0;
    rows of one id are drawn together. Columns named like the new ones are replaced.
    """
    temper = TEMPER if temper is None else temper
    facts = pack(docs, n_tokens=n_words(F.col(text_col)), topic=topic(F.col(text_col)), source=_label(source_col),
                 lang=_label(lang_col), draw=uniform(F.col(id_col)))
    counts = cut_lineage(facts.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")).filter("n > 0"))
    targets = {m: tempered_targets(counts, m, temper[m]) for m in MARGINS}
    cells, _ = rake(counts, targets, tol, settle=True)
    gaps = cut_lineage(margin_gaps(cells, targets))
    worst = gaps.agg(F.max_by(F.struct("margin", "value", "share", "target"), F.abs("gap")), F.max(F.abs("gap"))).first()
    if worst[1] is not None and worst[1] > 1e-6:
        warnings.warn(f"no weights meet all targets; the largest gap is {worst[1]:.3g}, of {worst[0]}")
    for m in MARGINS:
        of = gaps.filter(F.col("margin") == m).select(F.col("value").alias(m), F.col("gap").alias(f"gap_{m}"))
        cells = cells.join(maybe_broadcast(of), m)
    rate = F.col("w") / F.col("n")
    total = cells.agg(F.sum("n").alias("n"), F.max(rate).alias("top")).first()
    rates = cells.select(*MARGINS, (rate * F.lit(total["n"])).alias("w"), (rate / F.lit(total["top"])).alias("p"),
                         F.struct(*[F.col(f"gap_{m}").alias(m) for m in MARGINS]).alias("gap"))
    out = facts.join(maybe_broadcast(cut_lineage(rates)), list(MARGINS), "left")
    if_any = lambda c: F.when(F.col("n_tokens") > 0, F.col(c)).otherwise(F.lit(0.0))
    return unpack(out, docs.columns, topic=F.col("topic"), n_tokens=F.col("n_tokens"), weight=if_any("w"),
                  probability=if_any("p"), sampled=F.col("draw") < if_any("p"), gap=F.when(F.col("n_tokens") > 0, F.col("gap")))
