"""Joins: lookups, semi/anti, range, band, nearest, as-of, containment, all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandframe.operators.ordered import ordered_scan
from strandframe.session import cut_lineage, fits_broadcast, maybe_broadcast

#: Dictionaries up to this many entries are paired with sequences by a broadcast.
DICTIONARY_ROWS = 10_000


def semi(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids, on, "left_semi")


def anti(df: DataFrame, done: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return df.join(done, on, "left_anti")


def build_cohort(cd4: DataFrame, rna: DataFrame, regimen: DataFrame, seqs: DataFrame | None = None,
                 on: str = "pat") -> DataFrame:
    """Patients with both measurements and a regimen, with sequences where there are any.

    Inputs hold one row per patient.
    """
    out = cd4.join(rna, on).join(regimen, on)
    return out.join(seqs, on, "left") if seqs is not None else out


def assemble(blocks: list[DataFrame], on: str = "pat") -> DataFrame:
    """Feature blocks side by side for patients present in all of them."""
    return reduce(lambda a, b: a.join(b, on), blocks)


def left_default(df: DataFrame, lookup: DataFrame, on: str, defaults: dict[str, object],
                 order: list | None = None) -> DataFrame:
    """Left join with placeholders for missing values and, if asked, the rank of a forced order."""
    out = df.join(lookup, on, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    if order is not None:
        position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(on))
        out = out.withColumn("sort_key", F.when(position > 0, position))
    return out


def terms_for_species(links: DataFrame, species: DataFrame, name: str) -> DataFrame:
    """Links of one species, found by name in the species table."""
    chosen = species.filter(F.col("species_name") == name).select("species_id")
    return links.join(chosen, "species_id").drop("species_id")


def paths(closure: DataFrame, terms: DataFrame) -> DataFrame:
    """Ancestor and descendant names of each closure path."""
    upper = terms.select(F.col("term").alias("ancestor"), F.col("name").alias("ancestor_name"))
    lower = terms.select(F.col("term").alias("descendant"), F.col("name").alias("descendant_name"))
    return closure.join(upper, "ancestor").join(lower, "descendant")


def resolve(df: DataFrame, synonyms: DataFrame, col: str = "term") -> DataFrame:
    """Terms with synonyms ``(synonym, term)`` replaced by the accepted name."""
    table = synonyms.select(F.col("synonym").alias(col), F.col("term").alias("_accepted"))
    return df.join(table, col, "left").withColumn(col, F.coalesce("_accepted", col)).drop("_accepted")


def map_ids(ids: DataFrame, id_map: DataFrame, on: str = "key") -> DataFrame:
    """Left lookup that flags keys unknown to the map."""
    return ids.join(id_map, on, "left").withColumn("known", F.col("id").isNotNull())


def by_digest(a: DataFrame, b: DataFrame, seq_a: str, seq_b: str) -> DataFrame:
    """Rows of equal content, matched by digest."""
    return a.withColumn("digest", F.md5(seq_a)).join(b.withColumn("digest", F.md5(seq_b)), "digest")


def took(regimen: DataFrame, wanted: list[str]) -> DataFrame:
    """Regimen rows whose drug set contains every wanted drug."""
    return regimen.filter(F.size(F.array_except(F.array(*[F.lit(d) for d in wanted]), "drugs")) == 0)


def hit_boxes(members: DataFrame, genes: DataFrame) -> DataFrame:
    """Boxes with at least one of the genes."""
    return members.join(genes, "gene", "left_semi").select("box").distinct()


def pair_all(dictionary: DataFrame, rows: DataFrame, cells: int = 32) -> DataFrame:
    """Every row with every dictionary entry.

    A dictionary measured small is joined on a constant key by broadcast. A larger
    one is cut into blocks: both sides get (row block, entry block) keys, so the
    work spreads over ``cells``² equal join keys whatever the data look like.
    """
    if fits_broadcast(dictionary, DICTIONARY_ROWS):
        one = F.lit(0).alias("_k")
        return rows.withColumn("_k", F.lit(0)).join(F.broadcast(dictionary.select("*", one)), "_k").drop("_k")
    spread = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    left = rows.withColumn("_r", F.pmod(F.xxhash64(*rows.columns), F.lit(cells))).withColumn("_d", spread)
    right = dictionary.withColumn("_d", F.pmod(F.xxhash64(*dictionary.columns), F.lit(cells))).withColumn("_r", spread)
    left = left.withColumns({"_r": F.col("_r").cast("int"), "_d": F.col("_d").cast("int")})
    right = right.withColumns({"_r": F.col("_r").cast("int"), "_d": F.col("_d").cast("int")})
    # copies for every block are not in Spark's guess of a size, which would send them whole to the driver
    return left.join(right.hint("merge"), ["_r", "_d"]).drop("_r", "_d")


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], pos: str, lo: str, hi: str,
               closed: str = "left", bucket: int = 256) -> DataFrame:
    """Points inside ranges: equi keys plus a position bucket, so it plans as a hash or merge join.

    Ranges measured small go to the points, which then are not shuffled.
    """
    p = points.withColumn("_bucket", F.floor(F.col(pos) / bucket))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    upper = F.col(pos) <= F.col(hi) if closed == "both" else F.col(pos) < F.col(hi)
    return p.join(maybe_broadcast(r), [*on, "_bucket"]).filter((F.col(pos) >= F.col(lo)) & upper).drop("_bucket")


def band_join(a: DataFrame, b: DataFrame, on: list[str], col_a: str, col_b: str, tol: float) -> DataFrame:
    """Pairs with equal keys and ``|a - b| < tol``; each ``b`` row is tried in three buckets."""
    left = a.withColumn("_bucket", F.floor(F.col(col_a) / F.lit(tol)))
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(col_b) / F.lit(tol)) + d)
    right = b.withColumn("_bucket", F.explode(near))
    return left.join(right, [*on, "_bucket"]).filter(F.abs(F.col(col_a) - F.col(col_b)) < tol).drop("_bucket")


def nearest_join(a: DataFrame, b: DataFrame, on: list[str], tol: float, pos_a: str = "pos", pos_b: str = "site",
                 span: float | None = None) -> DataFrame:
    """Nearest ``b`` of each ``a`` within ``tol`` and its signed distance (ties: the lower one).

    Both sides are laid on one axis and each row looks to its neighbours, so the
    pairs of a crowded stretch are never formed. Only positions that occur are
    scanned, once each.
    """
    marks = b.select(*on, F.col(pos_b).alias("_p")).distinct().withColumn("_site", F.col("_p"))
    asked = a.select(*on, F.col(pos_a).alias("_p")).distinct().withColumn("_site", F.lit(None).cast(b.schema[pos_b].dataType))
    axis = asked.unionByName(marks).groupBy(*on, "_p").agg(F.max("_site").alias("_site"))
    scanned = ordered_scan(axis, on, "_p", [("_below", "last", F.col("_site")), ("_above", "next", F.col("_site"))],
                           span or max(1.0, tol * 64))
    down, up = F.col("_p") - F.col("_below"), F.col("_above") - F.col("_p")
    pick = F.when(F.col("_above").isNull() | (down <= up), F.col("_below")).otherwise(F.col("_above"))
    best = scanned.select(*on, F.col("_p").alias(pos_a), pick.alias(pos_b))
    out = a.join(best, [*on, pos_a]).withColumn("distance", F.col(pos_b) - F.col(pos_a))
    return out.filter(F.abs("distance") <= tol)


def asof_pair(timeline: DataFrame, times: list[int], keys: list[str], week: str = "week", val: str = "val",
              span: float = 512.0) -> DataFrame:
    """Previous and next measurement around each asked time, per key.

    ``timeline`` holds one value per (key, week).
    """
    who = timeline.select(*keys).distinct()
    points = F.array(*[F.lit(t).cast(timeline.schema[week].dataType) for t in times])
    asked = who.select(*keys, F.explode(points).alias(week))
    axis = (
        timeline.select(*keys, week, F.struct(F.col(week).alias("week"), F.col(val).alias("val")).alias("_m"), F.lit(0).alias("_ask"))
        .unionByName(asked.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
        .groupBy(*keys, week).agg(F.max("_m").alias("_m"), F.max("_ask").alias("_ask"))
    )
    scanned = ordered_scan(axis, keys, week, [("_prev", "last", F.col("_m")), ("_next", "next", F.col("_m"))], span)
    return scanned.filter("_ask = 1").select(
        *keys, F.col(week).alias("time"),
        F.col("_prev.week").alias("prev_week"), F.col("_prev.val").alias("prev_val"),
        F.col("_next.week").alias("next_week"), F.col("_next.val").alias("next_val"),
    )


#: Sets sharing an item are paired through the item up to this many sets; beyond it in blocks.
ITEM_CAP = 64
#: Sets per block and items per array that a pair of blocks is planned for.
SETS_PER_BLOCK = 512
ITEMS_PER_PART = 16_384


def _blocked_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Shared items (i, j, n) of sets met block by block.

    A set is cut into item arrays of bounded size, sets into blocks; two blocks meet on the
    key (block, block, part) and arrays are intersected in place, so an item held by very
    many sets is never expanded.
    """
    sizes = left.groupBy(*keys, "i").agg(F.count("*").alias("_n"))
    n, largest = sizes.agg(F.count("*"), F.max("_n")).first()
    blocks, parts = max(16, -(-n // SETS_PER_BLOCK)), max(1, -(-(largest or 1) // ITEMS_PER_PART))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def packed(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int").alias("part")
        block = F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias(own)
        arrays = df.groupBy(*keys, name, part).agg(F.collect_set("x").alias(f"x{name}"))
        return arrays.select(*keys, name, f"x{name}", "part", block, every.alias(other))

    met = packed(left, "i", "bi", "bj").join(packed(right, "j", "bj", "bi"), [*keys, "bi", "bj", "part"])
    return met.filter(F.col("i") < F.col("j")).select(*keys, "i", "j", F.size(F.array_intersect("xi", "xj")).cast("long").alias("n"))


#: Items of a set that one task counts the partners of.
ITEMS_PER_TASK = 1 << 20


def _listed_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Shared items (i, j, n) of sets met through items that few sets hold.

    An item brings the list of its sets to each of them, and the lists of a set are counted together, so a pair of sets
    becomes a row only where all its items are at hand. A very long set is cut into parts.
    """
    partners = right.groupBy(*keys, "x").agg(F.collect_list("j").alias("_js"))
    met = left.join(partners.hint("merge"), [*keys, "x"]).withColumn("_js", F.filter("_js", lambda j: j > F.col("i"))).filter(F.size("_js") > 0)
    long = left.groupBy(*keys, "i").agg(F.count("*").alias("_n")).filter(F.col("_n") > ITEMS_PER_TASK)
    if long.isEmpty():
        dealt = met.select(*keys, "i", "_js").repartition(*keys, "i")
        return dealt.select(*keys, "i", F.explode("_js").alias("j")).groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    part = F.coalesce(F.pmod(F.xxhash64("x"), F.ceil(F.col("_n") / ITEMS_PER_TASK)), F.lit(0)).cast("int")
    dealt = met.join(maybe_broadcast(long), [*keys, "i"], "left").select(*keys, "i", part.alias("_part"), "_js").repartition(*keys, "i", "_part")
    counts = dealt.select(*keys, "i", "_part", F.explode("_js").alias("j")).groupBy(*keys, "i", "_part", "j").agg(F.count("*").alias("n"))
    return counts.select(*keys, "i", "j", "n")


def overlap_counts(left: DataFrame, right: DataFrame, keys: list[str] = [], cap: int = ITEM_CAP) -> DataFrame:
    """Shared items of every pair with at least one: (keys, i, j, shared), i < j.

    ``left(keys, i, x)``, ``right(keys, j, x)``, both distinct. Sets that hold an item of few sets are met through
    lists of at most ``cap`` sets; the others go through blocks of sets. Both counts are added, so the result is whole.
    """
    on = [*keys, "x"]
    # repeated lists are small as files and large as rows, so Spark's guess by file size would send them whole to the driver
    right = right.hint("merge")
    held = left.groupBy(*on).agg(F.count("*").alias("_l")).join(right.groupBy(*on).agg(F.count("*").alias("_r")).hint("merge"), on)
    popular = cut_lineage(held.filter(F.greatest("_l", "_r") > cap).select(*on))
    if popular.isEmpty():
        counts = _listed_counts(left, right, keys)
    else:
        counts = _listed_counts(left.join(popular, on, "left_anti"), right.join(popular, on, "left_anti"), keys).unionByName(
            _blocked_counts(left.join(popular, on, "left_semi"), right.join(popular, on, "left_semi"), keys))
    return counts.groupBy(*keys, "i", "j").agg(F.sum("n").alias("shared")).filter("shared > 0")


def shared_counts(sets: DataFrame, set_col: str = "set_id", item_col: str = "item", cap: int = ITEM_CAP) -> DataFrame:
    """Number of shared items of every pair of sets with at least one: (i, j, shared), i < j."""
    rows = cut_lineage(sets.select(F.col(set_col).alias("i"), F.col(item_col).alias("x")).distinct())
    return overlap_counts(rows, rows.withColumnRenamed("i", "j"), cap=cap)


def all_pairs(sets: DataFrame, set_col: str = "set_id", item_col: str = "item") -> DataFrame:
    """Full overlap grid: shared count of every pair, -1 where nothing is shared.

    The grid of ids is formed block by block; a set brings what it shares with a block's sets along, so the grid itself is not shuffled.
    """
    ids = cut_lineage(sets.select(F.col(set_col).alias("i")).distinct())
    counted = shared_counts(sets, set_col, item_col)
    blocks = max(16, -(-ids.count() // SETS_PER_BLOCK))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def block(col: str) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int")

    known = counted.groupBy("i", block("j").alias("bj")).agg(F.map_from_entries(F.collect_list(F.struct("j", "shared"))).alias("_known"))
    left = ids.select("i", block("i").alias("bi"), every.alias("bj")).join(known.hint("merge"), ["i", "bj"], "left")
    right = ids.select(F.col("i").alias("j"), block("i").alias("bj"), every.alias("bi"))
    grid = left.join(right.hint("merge"), ["bi", "bj"]).filter(F.col("i") < F.col("j"))
    return grid.select("i", "j", F.coalesce(F.try_element_at("_known", F.col("j")), F.lit(-1).cast("long")).alias("shared"))


def block_pairs(ids: DataFrame, col: str, blocks: int = 8) -> DataFrame:
    """Ordered pairs (i < j) of ids, formed block by block."""
    b = F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = ids.select(F.col(col).alias("i"), b.alias("bi"), every.alias("bj"))
    right = ids.select(F.col(col).alias("j"), every.alias("bi"), b.alias("bj"))
    return left.join(right, ["bi", "bj"]).filter(F.col("i") < F.col("j")).select("i", "j")


def neighbours(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes one hop from the seeds (a node is not its own neighbour)."""
    hop = edges.join(seed.select(F.col("id").alias("a")).distinct(), "a", "left_semi").filter("a <> b")
    return hop.select(F.col("b").alias("id")).distinct()


def predict(motif_domain: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Motif-mediated interactions: h1 carries the binding domain, h2 the motif, and they are linked.

    ``motif_domain(motif, h1)``, symmetric ``edges(a, b)``, ``hits(motif, h2)``.
    """
    linked = motif_domain.distinct().join(edges.select(F.col("a").alias("h1"), F.col("b").alias("h2")).distinct(), "h1")
    return linked.filter("h1 <> h2").join(hits.select("motif", "h2").distinct(), ["motif", "h2"], "left_semi").select("motif", "h1", "h2")


def expand_by_domain(motif_proteins: DataFrame, pairs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Motif proteins plus the proteins that carry a domain paired with the motif."""
    added = pairs.filter(F.trim("domain") != "").join(annotations.select("domain", F.col("gene").alias("protein")), "domain")
    return motif_proteins.select("motif", "protein").union(added.select("motif", "protein")).distinct()


def expand_relations(rel: DataFrame, members: DataFrame, alias: DataFrame | None = None,
                     symmetric: bool = False) -> DataFrame:
    """Typed edges between the members of related entries.

    ``rel(entry1, entry2, rel_type, subtypes array)``, ``members(entry, gene)``;
    ``alias(gene, complex)`` replaces a gene by its complex where known.
    """
    m = members.distinct()
    if alias is not None:
        m = m.join(alias, "gene", "left").select("entry", F.coalesce("complex", "gene").alias("gene")).distinct()
    first = m.select(F.col("entry").alias("entry1"), F.col("gene").alias("a"))
    second = m.select(F.col("entry").alias("entry2"), F.col("gene").alias("b"))
    out = (
        rel.select("entry1", "entry2", "rel_type", F.explode_outer("subtypes").alias("rel_subtype"))
        .join(first, "entry1").join(second, "entry2")
        .select("a", "b", "rel_type", "rel_subtype")
    )
    if symmetric:
        out = out.union(out.select("b", "a", "rel_type", "rel_subtype"))
    return out.distinct()
