"""Scalar helpers over sequence, term and id columns (Column in, Column out)."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The standard genetic code, bases in T, C, A, G order.
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): aa for c, aa in zip(product(_BASES, repeat=3), _AMINO)}

# Nucleotide ambiguity codes and the bases each stands for.
AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "-": "-",
}

#: Marks match positions inside a text; a private-use code point.
MARK = "\ue000"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` with Python's meaning of ``.`` (everything but a line feed)."""
    return ("(?di)" if ignore_case else "(?d)") + pattern


def _pattern(pattern, opening: str, closing: str, ignore_case: bool) -> Column:
    if isinstance(pattern, Column):
        return F.concat(F.lit(java_pattern(opening, ignore_case)), pattern, F.lit(closing))
    return F.lit(java_pattern(f"{opening}{pattern}{closing}", ignore_case))


_HITS = "array<struct<start:int,text:string>>"
_CLOSE = "\ue001"


def _bound(array: Column, use) -> Column:
    """``use`` of an array that is computed once: a one-element array around it binds it to a name."""
    return F.transform(F.array(array), use)[0]


#: Letters of a text that places are counted in at once.
_PIECE = 256


def mark_places(marked: Column) -> Column:
    """0-based places of all marks in a text; only pieces that hold a mark are looked at closely."""
    def within(piece, k):
        before = F.transform(F.sequence(F.lit(1), F.size(F.split(piece, MARK, -1)) - 1),
                             lambda n: F.lit(_PIECE) * k + F.length(F.call_function("substring_index", piece, F.lit(MARK), n)))
        return F.when(F.contains(piece, F.lit(MARK)), before).otherwise(F.array().cast("array<int>"))

    pieces = F.regexp_extract_all(marked, F.lit(f"(?s)(.{{1,{_PIECE}}})"), F.lit(1))
    return F.flatten(F.transform(pieces, within))


def _without(text: Column, *marks: str) -> Column:
    """``text`` with a replacement sign for every mark that is already in it."""
    clean = F.translate(text, "".join(marks), "\ufffd" * len(marks))
    found = F.contains(text, F.lit(marks[0]))
    for m in marks[1:]:
        found = found | F.contains(text, F.lit(m))
    return F.when(found, clean).otherwise(text)


def _marked_hits(text: Column, pattern: Column, starts: Column | None = None) -> Column:
    """Hits read off a text in which every match is set between two marks.

    The k-th piece after a mark is "match, closing mark, text up to the next match". Without
    ``starts`` matches are taken out of the text, and the k-th mark lies two marks per earlier hit too
    far right. Nothing is appended to, so the cost is linear in text and hits; the text is searched once.
    """
    def read(marked):
        places = F.transform(mark_places(marked), lambda at, k: at - 2 * k) if starts is None else starts
        found = F.transform(F.slice(F.split(marked, MARK, -1), 2, 2**30), lambda piece: F.substring_index(piece, _CLOSE, 1))
        # a match of nothing at the very end has no letter to carry a start
        return F.zip_with(places, found, lambda at, m: F.struct(F.coalesce(at, F.length(text)).cast("int").alias("start"), m.alias("text")))

    return _bound(F.regexp_replace(_without(text, MARK, _CLOSE), pattern, F.lit(f"{MARK}$1{_CLOSE}")), read).cast(_HITS)


def overlap_hits(text, pattern, ignore_case: bool = False) -> Column:
    """Every match start of ``pattern``, overlaps included: array<struct<start,text>>.

    A zero-width look-ahead copies each match in front of its start.
    """
    text = _c(text)
    return _marked_hits(text, _pattern(pattern, "(?=(", "))", ignore_case), mark_places(start_marks(text, pattern, ignore_case)))


def start_marks(text, pattern, ignore_case: bool = False) -> Column:
    """Text of the same length in which the first letter of every match is a mark."""
    return F.regexp_replace(_without(_c(text), MARK), _pattern(pattern, "(?=(?:", "))[\\s\\S]", ignore_case), F.lit(MARK))


def plain_hits(text, pattern, ignore_case: bool = False) -> Column:
    """Left-to-right matches that do not overlap: array<struct<start,text>>."""
    return _marked_hits(_c(text), _pattern(pattern, "(", ")", ignore_case))


def match_count(text, pattern: str, ignore_case: bool = False) -> Column:
    """Number of match starts, overlaps included, without building positions."""
    return F.regexp_count(_c(text), F.lit(java_pattern(f"(?=(?:{pattern}))", ignore_case)))


def clean_seq(col, alphabet: str = "ACGT") -> Column:
    """Upper case without gap signs and other non-letters; NULL when a letter is outside ``alphabet``."""
    seq = F.regexp_replace(F.upper(_c(col)), "[^A-Z]", "")
    return F.when(seq.rlike(f"^[{alphabet}]*$"), seq)


def complement(col) -> Column:
    return F.translate(_c(col), "ACGTacgt", "TGCAtgca")


def orientations(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Four rows per sequence: as is, reversed, complement, reverse complement."""
    s = F.col(seq)
    forms = (("forward", s), ("reverse", F.reverse(s)), ("complement", complement(s)),
             ("reverse_complement", F.reverse(complement(s))))
    rows = F.array(*[F.struct(F.lit(n).alias("orientation"), v.alias("oriented")) for n, v in forms])
    keep = [c for c in df.columns if c != seq]
    return df.select(*keep, F.inline(rows)).withColumnRenamed("oriented", seq)


def tail_seq(col, n: int) -> Column:
    """Last ``n`` letters (all of them when shorter)."""
    return F.right(_c(col), F.lit(n))


def translate_codons(col, to_stop: bool = True) -> Column:
    """Protein of a coding sequence; unknown codons become X, reading ends at the first stop."""
    table = F.create_map(*[F.lit(v) for pair in CODONS.items() for v in pair])
    codons = F.regexp_extract_all(F.upper(_c(col)), F.lit("(?s)(...)"), F.lit(1))
    protein = F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")
    return F.substring_index(protein, "*", 1) if to_stop else protein


_LETTERS = sorted({c for codon in CODONS for c in codon})
#: Place of a letter's code point among the codons' letters, one past them for all others; amino acid of three places.
_PLACE = np.full(256, len(_LETTERS))
_PLACE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))
_AMINO_AT = np.array([ord(CODONS.get("".join(c), "X")) for c in product([*_LETTERS, "?"], repeat=3)], np.uint8)


def _protein(text: str) -> np.ndarray:
    """``translate_codons`` to the end, a byte per amino acid."""
    points = np.frombuffer(text.upper().encode("utf-32-le", "surrogatepass"), np.uint32)
    places = _PLACE[np.minimum(points, 255)][:len(points) // 3 * 3].reshape(-1, 3)
    return _AMINO_AT[places @ np.array([(len(_LETTERS) + 1) ** 2, len(_LETTERS) + 1, 1])]


def _frames(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        frames, starts, proteins = [], [], []
        for f in range(3 if text else 0):
            amino = _protein(text[f:])
            begins, stops = np.flatnonzero(amino == ord("M")), np.append(np.flatnonzero(amino == ord("*")), len(amino))
            letters = amino.tobytes().decode("ascii")
            frames += [f] * len(begins)
            starts += (begins * 3 + f).tolist()
            proteins += [letters[i:j] for i, j in zip(begins.tolist(), stops[np.searchsorted(stops, begins)].tolist())]
        rows.append((frames, starts, proteins))
    return pd.DataFrame(rows, columns=["frame", "start", "protein"])


def orfs(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """Open frames beginning at every start codon: (frame, start, protein).

    Codons are looked up a text at a time, in Arrow batches.
    """
    keep = [c for c in seqs.columns if c != seq]
    found = F.pandas_udf(_frames, "struct<frame: array<int>, start: array<int>, protein: array<string>>")(F.col(seq))
    return seqs.select(*keep, found.alias("_f")).select(*keep, F.inline(F.arrays_zip("_f.frame", "_f.start", "_f.protein")))


def base_weights(spark: SparkSession) -> DataFrame:
    """Ambiguity code → weight of each base it stands for."""
    rows = [(code, base, 1.0 / len(bases)) for code, bases in AMBIGUITY.items() for base in bases]
    return spark.createDataFrame(rows, "code string, base string, weight double")


def onehot_base(col) -> Column:
    """Five 0/1 flags for A, C, G, T and gap; NULL flags for anything else."""
    c = F.upper(_c(col))
    known = c.isin("A", "C", "G", "T", "-")
    return F.struct(*[
        F.when(known, (c == b).cast("int")).alias(n)
        for b, n in (("A", "is_a"), ("C", "is_c"), ("G", "is_g"), ("T", "is_t"), ("-", "is_gap"))
    ])


def clean_term(col) -> Column:
    """Term without its database ending, outer white space and outer commas.

    A term that ends in ``O`` loses its last four letters; one with ``hsa`` eight to six letters from
    the end loses its last ten. Commas inside stay.
    """
    t = _c(col)
    human = F.substring(F.right(t, F.lit(8)), 1, 3) == "hsa"
    cut = F.when(t.endswith("O"), F.lit(4)).when((F.length(t) >= 8) & human, F.lit(10)).otherwise(F.lit(0))
    return F.btrim(F.btrim(F.left(t, F.greatest(F.length(t) - cut, F.lit(0))), F.lit(" \t\r\n")), F.lit(","))


def _quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)


def split_multi(col, separator: str = "///") -> Column:
    """Trimmed, non-empty parts of a multi-value cell."""
    parts = F.transform(F.split(_c(col), _quote(separator)), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def strip_ns(col) -> Column:
    """Id without its namespace prefix (``hsa:10`` → ``10``)."""
    c = _c(col)
    return F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", -1)).otherwise(c)


def add_ns(col, namespace: str) -> Column:
    return F.concat(F.lit(namespace + ":"), _c(col))


def order_by_int(df: DataFrame, col: str) -> DataFrame:
    """Rows in numeric order of a string key."""
    return df.orderBy(F.expr(f"try_cast(`{col}` AS BIGINT)").asc_nulls_last())


def hash_seq(col, method: str = "md5") -> Column:
    """Content key of a sequence: ``md5``, ``xxhash64`` or the positional product of base codes."""
    c = _c(col)
    if method == "md5":
        return F.md5(c)
    if method == "xxhash64":
        return F.xxhash64(c)
    # each base weighs its distance to the end; partial sums are multiplied together
    letters = F.split(F.upper(c), "")
    n = F.length(c)
    codes = F.transform(letters, lambda x, i: (F.instr(F.lit("ACGT"), x) * (n - i)).cast("double"))
    return F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("product")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["product"] * (a["sum"] + x)).alias("product")),
        lambda a: a["product"],
    )


def mismatch_neighbours(df: DataFrame, k: int = 1, seq: str = "seq", alphabet: str = "ACGT") -> DataFrame:
    """Each word with every word at 0..k substitutions and the changed positions (0-based)."""
    keep = [c for c in df.columns if c != seq]
    current = df.select(*keep, seq, F.col(seq).alias("neighbour"), F.array().cast("array<int>").alias("changed"))
    levels = [current]
    for _ in range(k):
        last = F.coalesce(F.try_element_at("changed", F.lit(-1)), F.lit(-1))
        sites = F.when(last + 1 < F.length(seq), F.sequence(last + 1, F.length(seq) - 1))
        current = (
            current.withColumn("site", F.explode(sites))
            .withColumn("letter", F.explode(F.array(*[F.lit(a) for a in alphabet])))
            .filter(F.expr(f"substring(`{seq}`, site + 1, 1) <> letter"))
            .select(*keep, seq,
                    F.expr("overlay(neighbour PLACING letter FROM site + 1)").alias("neighbour"),
                    F.array_append("changed", F.col("site")).alias("changed"))
        )
        levels.append(current)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def boxcox_value(x, lam) -> Column:
    x, lam = _c(x), _c(lam)
    return F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def inv_boxcox(y, lam) -> Column:
    y, lam = _c(y), _c(lam)
    return F.when(F.abs(lam) < 1e-12, F.exp(y)).otherwise(F.pow(y * lam + 1, 1 / lam))


def mask_vector(length, intervals) -> Column:
    """String of 0/1 over 0..length-1 from sorted, disjoint array<struct<start,end>> (half-open)."""
    length = _c(length).cast("int")

    def mask(ivs):
        def end(k):  # of the interval before the k-th
            return F.when(k == 0, F.lit(0)).otherwise(F.least(F.get(ivs, k - 1)["end"], length)).cast("int")
        parts = F.transform(ivs, lambda iv, k: F.concat(
            F.repeat(F.lit("0"), iv["start"].cast("int") - end(k)),
            F.repeat(F.lit("1"), F.least(iv["end"], length).cast("int") - iv["start"].cast("int"))))
        return F.concat(F.array_join(parts, ""), F.repeat(F.lit("0"), length - end(F.size(ivs))))

    return _bound(_c(intervals), mask)


def pad(col, n, filler=0) -> Column:
    """Array brought to ``n`` elements by appending ``filler``."""
    c, n = _c(col), (F.lit(n) if isinstance(n, int) else n)
    return F.when(F.size(c) < n, F.concat(c, F.array_repeat(F.lit(filler), n - F.size(c)))).otherwise(c)


def markup(seq, intervals, opening: str = "<b>", closing: str = "</b>") -> Column:
    """Sequence with the given sorted, disjoint half-open intervals wrapped in marks."""
    both = F.struct(F.split(_c(seq), "").alias("letters"), _c(intervals).alias("ivs"))

    def marked(b):
        letters, ivs = b["letters"], b["ivs"]

        def text(start, end):
            return F.array_join(F.slice(letters, start + 1, F.greatest(end - start, F.lit(0))), "")

        def end(k):
            return F.when(k == 0, F.lit(0)).otherwise(F.get(ivs, k - 1)["end"]).cast("int")

        parts = F.transform(ivs, lambda iv, k: F.concat(
            text(end(k), iv["start"].cast("int")), F.lit(opening), text(iv["start"].cast("int"), iv["end"].cast("int")), F.lit(closing)))
        return F.concat(F.array_join(parts, ""), text(end(F.size(ivs)), F.size(letters)))

    return _bound(both, marked)


def mark_mismatch(hit, query) -> Column:
    """``hit`` with letters that differ from ``query`` in lower case."""
    letters = F.zip_with(
        F.split(_c(hit), ""), F.split(_c(query), ""),
        lambda h, q: F.when(F.upper(h) == F.upper(q), F.upper(h)).otherwise(F.lower(h)),
    )
    return F.array_join(letters, "")


def hamming(a, b) -> Column:
    """Number of differing letters of two equally long words."""
    pairs = F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, v: acc + v)


def chunks(text, step: int, overlap: int) -> Column:
    """Pieces of ``step`` letters, each followed by ``overlap`` letters of context.

    One regex pass, so a long text costs linear time.
    """
    text = _c(text)
    if overlap:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{step + overlap}}})).{{1,{step}}}"), F.lit(1))
    else:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))
    return F.when(F.length(text) <= step, F.array(text)).otherwise(pieces)


def windows(seqs: DataFrame, size: int = 500, overlap: int = 100, seq: str = "seq") -> DataFrame:
    """Overlapping pieces of long sequences with the offset that lifts their coordinates back."""
    keep = [c for c in seqs.columns if c != seq]
    return (
        seqs.select(*keep, F.posexplode(chunks(seq, size, overlap)).alias("part", seq))
        .withColumn("offset", (F.col("part") * size).cast("int"))
    )
