"""Readers on small hand-written files."""

from strandframe.sources import fasta, genbank, html, sinks, tables


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_fasta_last_duplicate_wins_and_key(spark, tmp_path):
    path = put(tmp_path, "a.fasta", ">one x\nACGT\nAC\n>two\nGG\n\n>one x\nTTTT\n")
    assert rows(fasta.read_fasta(spark, path), "seq_id", "seq") == [("one x", "TTTT"), ("two", "GG")]
    from pyspark.sql import functions as F
    keyed = fasta.read_fasta(spark, path, key=lambda h: F.split(h, " ")[0])
    assert rows(keyed, "seq_id", "seq") == [("one", "TTTT"), ("two", "GG")]
    out = str(tmp_path / "out")
    fasta.write_fasta(keyed, out, 3)
    assert rows(fasta.read_fasta(spark, out), "seq_id", "seq") == [("one", "TTTT"), ("two", "GG")]


def test_headers(spark):
    df = spark.createDataFrame([("PtID 12|Alias q|Week -4",), ("gi|1|ref|NM_1|x",)], "header string")
    assert [tuple(r) for r in fasta.parse_header(df).select("pat", "week").collect()] == [(12, -4.0), (None, None)]
    assert fasta.parse_header(df, "pipe").collect()[1]["name"] == "NM_1"


def test_clinic_files(spark, tmp_path):
    put(tmp_path, "S1_CD4.txt", "PtID\tCD4Date\tCD4Count\n1\t0\t100\n1\t4\tNaN\n")
    put(tmp_path, "S1_RNA.txt", "PtID\tRNADate\tVLoad\tVLoadMatch\n1\t0\t5.5\t>\n1\t8\t2.0\t<\n")
    put(tmp_path, "S1_RX.txt", "PtID\tAlias\tEDU\tDOU\tStartDate\tStopDate\tAZT\t3TC\n1\tx\t0\t0\t0\t24\t1\t1\n1\tx\t0\t0\t24\t48\t0\t1\n")
    put(tmp_path, "S1_PR_fasta.txt", ">PtID 1|Alias x|Week 0\nACGT\n")
    study = tables.read_study_dir(spark, str(tmp_path))
    assert rows(study["cd4"], "pat", "week", "val", "study") == [(1, 0.0, 100.0, "S1"), (1, 4.0, None, "S1")]
    assert rows(study["rna"], "week", "censor") == [(0.0, 1), (8.0, -1)]
    assert rows(study["regimen"], "start", "drug") == [(0.0, "3TC"), (0.0, "AZT"), (24.0, "3TC")]
    assert rows(study["sequences"], "pat", "seq", "study") == [(1, "ACGT", "S1")]


def test_gene_files(spark, tmp_path):
    (tmp_path / "gmt").mkdir()
    put(tmp_path / "gmt", "a.gmt", "s1\tna\tA\tB\n")
    put(tmp_path / "gmt", "b.gmt", "s2\tna\tC\n")
    assert rows(tables.read_gmt(spark, str(tmp_path / "gmt")), "collection", "set_name", "gene") == [("a", "s1", "A"), ("a", "s1", "B"), ("b", "s2", "C")]
    bins = put(tmp_path, "bins.txt", "m1\n0,10,20\nm2\n5 6\n")
    got = tables.read_bins(spark, bins)
    assert rows(got, "motif", "edges") == [("m1", [0, 10, 20]), ("m2", [5, 6])]
    tables.write_bins(got, str(tmp_path / "bins_out"))
    assert rows(tables.read_bins(spark, str(tmp_path / "bins_out")), "motif", "edges") == rows(got, "motif", "edges")
    rules = put(tmp_path, "rules.txt", "prec\ttrail\tcons\tpos\tmut\tgene\nAB\tCD\tM\t41\tL\trt\n")
    assert rows(tables.read_site_rules(spark, rules), "rule", "gene", "wild", "mutant") == [("M 41", "rt", "[AB][M][CD]", "[AB][L][CD]")]
    mirna = put(tmp_path, "mi.txt", "# comment\n1\ta\tb\tx\tc\tac-g\td\n2\ta\tb\tx\tc\taa-cc\td\n")
    assert rows(tables.read_mirna(spark, mirna), "name", "seq") == [("x", "AACC")]
    genes = spark.createDataFrame([("gag", 100)], "gene string, start int")
    sites = put(tmp_path, "sites.txt", "GAG\t2\t4\tq\tMATCH\t[A]\nno\t1\t2\tq\tX\t[A]\n")
    assert rows(tables.read_sites(spark, sites, "AA", genes), "gene", "start", "end", "match") == [("gag", 106, 112, "MATCH")]
    sites = put(tmp_path, "nt.txt", "s1\t7\t(+)\t0.9\t0.8\tACGT\t\"V$x\"\n")
    assert rows(tables.read_sites(spark, sites, "NT"), "gene", "start", "end", "name", "match") == [("s1", 7, 11, "V$x", "ACGT")]


def test_expression_dir(spark, tmp_path):
    put(tmp_path, "d1.expr.txt", "probe\tGSM1a\tGSM2a\np1\t1.5\t2.5\n")
    put(tmp_path, "d1.cls.txt", "D0 control\nGSM1 D0\nGSM2 D1\n")
    put(tmp_path, "d2.expr.txt", "probe\tX1\np1\tNaN\n")
    put(tmp_path, "d2.cls.txt", "X1 2\n")
    got = tables.read_expression_dir(spark, str(tmp_path))
    cells = {(r["dataset"], r["sample"]): (r["value"], r["cls"]) for r in got.collect()}
    assert cells == {("d1", "GSM1a"): (1.5, 0), ("d1", "GSM2a"): (2.5, 1), ("d2", "X1"): (None, 2)}


def test_genbank(spark, tmp_path):
    put(tmp_path, "r1.gb", """LOCUS       r1
FEATURES             Location/Qualifiers
     source          1..30
     CDS             join(4..12,15..20)
                     /gene="tat"
                     /product="tat
                     protein"
                     /translation="MK
                     L"
     CDS             22..30
                     /gene="gag-pol"
ORIGIN
        1 acgtacgtac gtacgtacgt
       21 acgtacgtac
//
""")
    assert rows(genbank.read_genbank(spark, str(tmp_path)), "ref_id", "gene", "product", "start", "end", "aa") == [("r1", "tat", "tat protein", 3, 12, "MKL")]
    assert genbank.genome_sequences(spark, str(tmp_path)).first()["seq"] == "ACGTACGTAC" * 1 + "GTACGTACGT" + "ACGTACGTAC"


def test_pages(spark, tmp_path):
    page = "<table><tr><td>Pattern:</td>\n<td class='x'> ...([ST])P.[KR] </td></tr></table>"
    put(tmp_path, "MOD_A.html", page)
    pages = html.read_pages(spark, str(tmp_path))
    assert rows(html.extract_motifs(pages), "name", "regex") == [("MOD_A", "...([ST])P.[KR]")]
    hits = spark.createDataFrame([(1, "<b>LIG_X</b> at 3-7 and 9-12 <b>MOD_Y</b> 1-2")], "page_id int, html string")
    assert rows(html.extract_hits(hits), "name", "start", "end") == [("LIG_X", 2, 7), ("LIG_X", 8, 12), ("MOD_Y", 0, 2)]
    nested = spark.createDataFrame([(1, "<table><tr><td>a<table><tr><td>b</td><td>c</td></tr></table></td><td>d</td></tr></table>")], "page_id int, html string")
    assert rows(html.extract_tables(nested), "table", "row", "col", "text") == [(0, 0, 0, ""), (0, 0, 1, "d"), (1, 0, 0, "b"), (1, 0, 1, "c")]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x")], "id int, l array<string>, t string")
    assert rows(sinks.flatten_for_export(df), "id", "l", "t") == [("1", "a, b", " "), ("2", " ", "x")]
    sinks.write_tables({"t": df}, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w" / "t"), header=True).count() == 2
