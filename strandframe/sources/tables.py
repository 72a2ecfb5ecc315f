"""Delimited files of the lab and the clinic, read into long tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.functions.scalars import clean_term, split_multi
from strandframe.operators.network import symmetric
from strandframe.operators.ordered import union_all
from strandframe.session import maybe_broadcast


def _number(col: str, kind: str = "DOUBLE"):
    """Number or NULL (also for the text NaN)."""
    return F.expr(f"nullif(try_cast(trim(`{col}`) AS {kind}), CAST('NaN' AS DOUBLE))" if kind == "DOUBLE" else f"try_cast(trim(`{col}`) AS {kind})")


# --- networks and lists -----------------------------------------------------

def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r", "")).alias("id")).filter("id <> ''").distinct()


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Undirected tab-separated edges, both directions, once."""
    raw = spark.read.csv(path, sep="\t", schema="a string, b string")
    return symmetric(raw.select(F.trim("a").alias("a"), F.trim("b").alias("b")).filter("a <> '' AND b <> ''"))


def read_annotations(spark: SparkSession, path: str, tools: list[str] | None = None) -> DataFrame:
    """Six-column protein annotation, optionally of some tools only. Coordinates become 0-based half-open."""
    df = spark.read.csv(path, sep="\t", schema="gene string, start int, stop int, domain string, seq string, tool string")
    if tools:
        df = df.filter(F.col("tool").isin(*tools))
    return df.select("gene", (F.col("start") - 1).alias("start"), F.col("stop").alias("end"), "domain", "seq", "tool")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Chromosome positions, each once."""
    return spark.read.csv(path, sep="\t", schema="chrom string, pos long").distinct()


def read_id_map(spark: SparkSession, path: str, keys: list[str], id_col: str, sep: str = "\t") -> DataFrame:
    """Several key columns that lead to one id: (key, id), empty keys dropped."""
    df = spark.read.csv(path, sep=sep, header=True)
    entries = F.array(*[F.trim(F.col(f"`{k}`")) for k in keys])
    rows = df.select(F.explode(entries).alias("key"), F.trim(F.col(f"`{id_col}`")).alias("id"))
    return rows.filter("key <> '' AND id <> ''").distinct()


def convert(spark: SparkSession, path_in: str, path_out: str) -> None:
    """Tab-separated to comma-separated."""
    spark.read.csv(path_in, sep="\t").write.csv(path_out)


# --- clinic -------------------------------------------------------------------

def read_measure(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Measurements (patient, date, value[, censor sign]): (pat, week, kind, val, censor)."""
    df = spark.read.csv(path, sep="\t", header=True)
    cols = df.columns
    sign = F.trim(F.col(f"`{cols[3]}`")) if len(cols) > 3 else F.lit(None).cast("string")
    censor = F.when(sign == ">", 1).when(sign == "<", -1).when(sign == "=", 0)
    return df.select(_number(cols[0], "BIGINT").alias("pat"), _number(cols[1]).alias("week"), F.lit(kind).alias("kind"),
                     _number(cols[2]).alias("val"), censor.alias("censor"))


def read_regimen(spark: SparkSession, path: str, drugs: list[str] | None = None, first_drug: int = 6) -> DataFrame:
    """Regimens with one 0/1 column per drug from the seventh column on: (pat, start, stop, drug)."""
    df = spark.read.csv(path, sep="\t", header=True)
    flags = [c for c in df.columns[first_drug:] if drugs is None or c in drugs]
    base = df.select(_number("PtID", "BIGINT").alias("pat"), _number("StartDate").alias("start"), _number("StopDate").alias("stop"), *[F.col(f"`{c}`") for c in flags])
    long = base.unpivot(["pat", "start", "stop"], flags, "drug", "taken")
    return long.filter(F.expr("try_cast(taken AS INT) = 1")).drop("taken")


def regimen_sets(regimen: DataFrame) -> DataFrame:
    """Drug set of each regimen: (pat, start, stop, drugs)."""
    return regimen.groupBy("pat", "start", "stop").agg(F.sort_array(F.collect_set("drug")).alias("drugs"))


STUDY_FILE = r"([^/_]+)_([A-Za-z0-9]+)(?:_[A-Za-z0-9]+)?\.[A-Za-z]+$"


def with_study(df: DataFrame) -> DataFrame:
    """Adds study name and role of the file each row came from (``<study>_<role>….txt``)."""
    name = F.input_file_name()
    return df.withColumns({"study": F.regexp_extract(name, STUDY_FILE, 1), "role": F.regexp_extract(name, STUDY_FILE, 2)})


def read_study_dir(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All studies of a folder: cd4 and rna measurements, regimens and sequences, each with its study.

    Column lists of regimen files may differ, so each is read on its own header.
    """
    from strandframe.sources.fasta import parse_header, parse_records

    def files(role: str) -> list[str]:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*_{role}*").load(path).select("path")
        return sorted(r["path"] for r in listed.collect())

    def study(file: str):
        import re
        return F.lit(re.search(STUDY_FILE, file).group(1))

    out = {}
    for role in ("CD4", "RNA"):
        parts = [read_measure(spark, f, role).withColumn("study", study(f)) for f in files(role)]
        if parts:
            out[role.lower()] = union_all(parts)
    parts = [read_regimen(spark, f).withColumn("study", study(f)) for f in files("RX")]
    if parts:
        out["regimen"] = union_all(parts)
    fasta = [parse_header(parse_records(spark.read.option("lineSep", "\n>").text(f))).select("pat", "week", "seq", study(f).alias("study")) for f in files("PR")]
    if fasta:
        out["sequences"] = union_all(fasta)
    return out


# --- gene lists and annotation -------------------------------------------------

def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets of every file in a folder: (collection, set_name, gene)."""
    raw = spark.read.text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1).alias("collection"), F.split("value", "\t").alias("f"))
    rows = raw.filter(F.size("f") > 2).select("collection", F.col("f")[0].alias("set_name"), F.explode(F.slice("f", F.lit(3), F.size("f"))).alias("gene"))
    return rows.select("collection", "set_name", F.trim("gene").alias("gene")).filter("gene <> ''")


def read_chart(spark: SparkSession, path: str) -> DataFrame:
    """Enrichment chart: (category, term, count, pvalue, genes array)."""
    df = spark.read.csv(path, sep="\t", header=True)
    genes = F.filter(F.transform(F.split("Genes", ","), lambda g: F.trim(g)), lambda g: g != "")
    return df.select(F.trim("Category").alias("category"), F.trim("Term").alias("term"), _number("Count", "INT").alias("count"),
                     _number("PValue").alias("pvalue"), genes.alias("genes"))


def read_annotation_table(spark: SparkSession, path: str, gene: str, categories: list[str]) -> DataFrame:
    """Wide annotation with one column per category: (category, term, gene).

    A cell lists ``id:name`` pairs with commas between: the id is the last word before a colon, the
    name runs to the next one. Terms are given as ``id:cleaned name``.
    """
    df = spark.read.csv(path, sep="\t", header=True).select(F.trim(F.col(f"`{gene}`")).alias("gene"), *[F.col(f"`{c}`") for c in categories])
    long = df.unpivot(["gene"], categories, "category", "cell").filter("cell IS NOT NULL")
    parts = F.transform(F.split(F.btrim(F.trim("cell"), F.lit(",")), ":"), lambda x: F.trim(x))
    last_word = lambda x: F.element_at(F.split(x, r"\s+"), -1)
    terms = F.transform("_parts", lambda x, i: F.when(
        (x != "") & (i + 1 < F.size("_parts")), F.concat(last_word(x), F.lit(":"), clean_term(F.get("_parts", i + 1)))))
    rows = long.select("category", "gene", parts.alias("_parts")).select("category", "gene", F.explode(terms).alias("term"))
    return rows.filter("term IS NOT NULL").select("category", "term", "gene").distinct()


def read_gene2term(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    """Gene to term links of the listed genes."""
    df = spark.read.csv(path, sep="\t", header=True,
                        schema="tax string, gene string, term string, evidence string, qualifier string, name string, pubmed string, category string")
    return df.select("tax", "gene", "term", "name", "category").join(maybe_broadcast(genes.select("gene").distinct()), "gene", "left_semi")


CHIP_STYLES = {
    # columns: probe, gene symbol, multi-value annotation columns
    "affy": ("Probe Set ID", "Gene Symbol", ["Pathway", "Gene Ontology Biological Process"]),
    "web": ("Probe", "Symbol", ["Pathway", "GO"]),
}


def read_chip_annotation(spark: SparkSession, path: str, style: str = "affy", columns: tuple[str, str, list[str]] | None = None,
                         sep: str = ",") -> DataFrame:
    """Chip annotation: (probe, gene, category, term), control probes dropped, ``///`` cells split."""
    probe, gene, categories = columns or CHIP_STYLES[style]
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"').select(
        F.col(f"`{probe}`").alias("probe"), F.col(f"`{gene}`").alias("gene"), *[F.col(f"`{c}`") for c in categories])
    df = df.filter(~F.contains("probe", F.lit("AFFX")))
    long = df.unpivot(["probe", "gene"], categories, "category", "terms").filter("terms IS NOT NULL AND terms <> '---'")
    return long.select("probe", "gene", "category", F.explode(split_multi("terms")).alias("cell")).select(
        "probe", "gene", "category", F.trim(F.coalesce(F.get(F.filter(F.split("cell", "//"), lambda x: ~x.rlike(r"^\s*\d*\s*$")), F.lit(0)), F.col("cell"))).alias("term"))


def read_expression(spark: SparkSession, matrix: str, classes: str, dataset: str) -> DataFrame:
    """Expression matrix with sample classes: (dataset, probe, sample, value, cls).

    The class file maps a sample name prefix to ``D<n>`` or ``<n>``.
    """
    # rows stay text until they are cells: a column per sample would not plan for many samples
    raw = spark.read.text(matrix)
    head = raw.first()
    head = head[0] if head else ""
    header = spark.createDataFrame([(head,)], "head string").select(F.posexplode(F.split("head", "\t")).alias("_at", "sample")).filter("_at > 0")
    header = header.select("_at", F.trim("sample").alias("sample"))
    # by digest, as the line of a wide matrix is no constant for a plan
    rows = raw.filter(F.sha2("value", 256) != hashlib.sha256(head.encode()).hexdigest())
    cells = rows.select(F.trim(F.substring_index("value", "\t", 1)).alias("probe"), F.split("value", "\t").alias("_c")).select("probe", F.posexplode("_c").alias("_at", "value"))
    long = cells.filter("_at > 0").join(maybe_broadcast(header), "_at").drop("_at")
    table = spark.read.text(classes).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") == 2)
    table = table.select(F.col("f")[0].alias("prefix"), F.expr("try_cast(regexp_replace(f[1], '^D', '') AS INT)").alias("cls")).filter(
        "cls IS NOT NULL AND NOT (prefix RLIKE '^D[0-9]+$')")
    # a name is looked up by each of its beginnings: comparing every name with every prefix grows with their product
    beginnings = header.select("sample").distinct().select("sample", F.explode(F.sequence(F.lit(0), F.length("sample"))).alias("_n"))
    beginnings = beginnings.select("sample", F.expr("left(sample, _n)").alias("prefix"))
    known = beginnings.join(table, "prefix").groupBy("sample").agg(F.max_by("cls", F.length("prefix")).alias("cls"))
    return long.join(maybe_broadcast(known), "sample").select(F.lit(dataset).alias("dataset"), "probe", "sample", _number("value").alias("value"), "cls")


def read_expression_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every dataset of a folder: ``<name>.expr.txt`` with ``<name>.cls.txt``."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.expr.txt").load(path).select("path").collect()
    parts = []
    for r in sorted(listed, key=lambda r: r["path"]):
        stem = r["path"][: -len(".expr.txt")]
        parts.append(read_expression(spark, r["path"], stem + ".cls.txt", stem.rsplit("/", 1)[-1]))
    return union_all(parts)


# --- sites, bins, small RNAs -----------------------------------------------------

def read_site_rules(spark: SparkSession, path: str) -> DataFrame:
    """Resistance sites as two patterns: (rule, gene, wild, mutant).

    Tab-separated with a header line: preceding, trailing and wild-type letters, position, mutant
    letters, gene. A rule is named by wild-type letters and position.
    """
    df = spark.read.csv(path, sep="\t", header=True, schema="prec string, trail string, cons string, pos string, mut string, gene string")

    def pattern(x: str):
        return F.concat(F.lit("["), F.col("prec"), F.lit("]["), F.col(x), F.lit("]["), F.col("trail"), F.lit("]"))

    return df.select(F.concat_ws(" ", "cons", "pos").alias("rule"), F.trim("gene").alias("gene"), pattern("cons").alias("wild"), pattern("mut").alias("mutant"))


def read_mirna(spark: SparkSession, path: str) -> DataFrame:
    """Small RNAs: upper case, gaps removed, the last of equal names stays.

    Tab-separated after one comment line; the name is the fourth column, the sequence the sixth.
    """
    columns = ", ".join(f"c{i} string" for i in range(1, 7))
    raw = spark.read.csv(path, sep="\t", header=True, schema=columns).withColumn(
        "_order", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))
    seq = F.upper(F.replace(F.trim("c6"), F.lit("-"), F.lit("")))
    return raw.groupBy(F.col("c4").alias("name")).agg(F.max_by(seq, "_order").alias("seq"))


def regroup_hits(df: DataFrame) -> DataFrame:
    """Hits of split sequences put back together.

    A name ``base|offset`` marks a piece; starts move by the offset and hits are grouped
    per (sequence, small RNA).
    """
    parts = F.split("seq_name", r"\|")
    offset = F.when(F.size(parts) > 1, F.expr(r"try_cast(split(seq_name, '\\|')[1] AS INT)")).otherwise(0)
    rows = df.select(parts[0].alias("seq_id"), "name", (F.col("start") + F.coalesce(offset, F.lit(0))).alias("start"), "p_val")
    return rows.distinct().groupBy("seq_id", "name").agg(F.sort_array(F.collect_list(F.struct("start", "p_val"))).alias("hits"))


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """Bin edge files, a name line followed by an edges line: (motif, edges)."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    pairs = F.expr("transform(sequence(0, int(size(l) / 2) - 1), i -> struct(trim(l[2 * i]) AS motif, split(trim(l[2 * i + 1]), '[,\\\\s]+') AS e))")
    return lines.select(F.inline(pairs)).select("motif", F.col("e").cast("array<int>").alias("edges"))


def write_bins(edges: DataFrame, path: str) -> None:
    """One text record per motif: name line, edges line."""
    edges.select(F.concat(F.col("motif"), F.lit("\n"), F.concat_ws(",", F.col("edges").cast("array<string>"))).alias("value")).write.text(path)


def read_sites(spark: SparkSession, path: str, kind: str, genes: DataFrame | None = None) -> DataFrame:
    """External site calls: (gene, start, end, name, match), tab-separated without a header.

    ``AA``: gene, start, end (amino acids of the gene), name, matched text; lifted to the genome by
    ``genes(gene, start)``, gene names compared in lower case, unknown genes dropped. ``NT``: sequence,
    start, two or three columns that are skipped, matched text, name; the end follows from the text.
    """
    from strandframe.operators.features import aa_to_nt
    if kind == "AA":
        df = spark.read.csv(path, sep="\t", schema="gene string, start int, end int, name string, match string")
        known = genes.select(F.lower("gene").alias("gene"), "start")
        return aa_to_nt(df.withColumn("gene", F.lower("gene")), maybe_broadcast(known)).select("gene", "start", "end", "name", "match")
    if kind == "NT":
        df = spark.read.csv(path, sep="\t", schema="gene string, start int, c3 string, c4 string, c5 string, match string, name string")
        return df.select("gene", "start", (F.col("start") + F.length("match")).alias("end"), "name", "match")
    raise ValueError(f"unknown coordinate kind {kind}")


def read_ontology(spark: SparkSession, path: str | None = None, jdbc: dict | None = None,
                  tables: tuple[str, ...] = ("term", "term2term", "graph_path", "association", "gene_product", "species", "term_synonym")) -> dict[str, DataFrame]:
    """Ontology tables from a folder of Parquet copies or a relational database."""
    if jdbc:
        return {t: spark.read.format("jdbc").options(**jdbc, dbtable=t).load() for t in tables}
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}
