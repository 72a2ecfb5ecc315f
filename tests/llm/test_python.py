"""Operators with Python in tasks, each against a brute-force version, a round trip or held-out labels."""

import base64
import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandframe.llm import decontam, graph, html, jaccard, langid, quality, simhash, urls, warc
from strandframe.session import run_folder
from strandframe.llm.plans import LISTED_HOSTS, QUERIES, URL_RULES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- near-duplicates

def brute_print(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k:k + size]) for k in range(max(len(words) - size + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return collections.Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root))


def test_near_duplicates_brute_force(spark):
    rows = texts_of(spark)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One  "), rows[3], (None, rows[4][1]), (1005, rows[7][1]), (1006, "long word " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == brute_components(rows)
    kept = simhash.near_dedup_stage(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_keeps_one_row_per_component(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "red green blue white " * 9)
    rows = [(None, a), (None, b), (None, a), (7, c), (7, "the quick brown fox " * 9), (8, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in simhash.near_dedup_stage(df).collect())
    assert kept == sorted([("None", a), ("None", b), ("7", c), ("7", rows[4][1])])


def brute_groups(texts):
    """Groups by five-word Jaccard similarity of 0.8 or more, as sets of positions."""
    sets = []
    for t in texts:
        words = WORD.findall((t or "").translate(LOWER))
        sets.append({" ".join(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set())
    same = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    root = roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if same(sets[a], sets[b])])
    groups = collections.defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(k)
    return list(groups.values())


def test_jaccard_dedup_brute_force(spark):
    rnd, words = random.Random(8), [f"w{k}" for k in range(300)]
    texts = [t for _, t in texts_of(spark)] + [None, "", "one", "One ", "a b c d", "a b c d e f"]
    for _ in range(6):  # copies with more and more words changed, some on either side of the threshold
        base = rnd.choices(words, k=rnd.choice([40, 150, 400]))
        for edits in (0, 1, 2, 3, 4, 6, 8, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    chain = [f"c{k}" for k in range(200)]  # neighbours are linked, ends are not
    texts += [" ".join(chain[k:k + 100]) for k in range(0, 100, 8)]
    texts += ["same line of boilerplate text here " + " ".join(rnd.choices(words, k=30)) for _ in range(30)]
    ids = [None if k % 9 == 0 else k // 2 for k in range(len(texts))]  # null and repeated ids
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    groups = brute_groups(texts)
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.near_dedup(df).collect())
    assert sum(kept.values()) == len(groups)
    for g in groups:
        least = min((ids[k] for k in g if ids[k] is not None), default=None)
        assert any(kept[least, texts[k]] for k in g if ids[k] == least)
    texts = df.select(F.col("doc_id").alias("id"), "text")
    marked = jaccard.marks(texts).cache()
    ends = lambda bucket: {(r.node, r.component) for r in graph.components(jaccard.links(marked, texts, bucket=bucket)).collect()}
    assert ends(3) == ends(2048)
    assert jaccard.near_dedup(df.limit(0)).count() == 0


def test_jaccard_rows_and_long_texts(spark):
    """Repeated rows, clashing columns and very long texts."""
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, "a b c d e f g", 5), (1, "a b c d e f g", 5), (1, "a b c d e f g", 6), (2, "h i j k l m", 1), (3, long, 0), (4, long + " more words at the end", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long").withColumn("hash", F.lit("x")).withColumn("row", F.lit(1)).withColumn("prefix", F.lit(2))
    kept = jaccard.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f g"), (2, "h i j k l m"), (3, long)]


def test_fingerprint_radius():
    """Sets at the threshold stay far within the radius, unrelated ones far outside."""
    rnd, linked, apart = np.random.default_rng(4), [], []

    def bits(found):
        other = found * np.uint64(0x9E3779B97F4A7C15)
        return [simhash.fingerprint(found), simhash.fingerprint(other ^ other >> np.uint64(32))]

    for _ in range(300):
        n = int(rnd.integers(jaccard.SMALL, 400))
        a, b = rnd.integers(0, 2**63, n, dtype=np.uint64), rnd.integers(0, 2**63, n, dtype=np.uint64)
        same = -(-8 * n // 9)  # equal sizes at similarity 4/5
        near = np.concatenate((a[:same], b[same:]))
        differ = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(bits(x), bits(y)))
        linked.append(differ(a, near))
        apart.append(differ(a, b))
    assert max(linked) <= jaccard.RADIUS - 3 and np.mean(np.array(apart) > jaccard.RADIUS) > 0.99


def test_links_in_tiles_lose_nothing(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(12)]
    prints = list({b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(40)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    place = {p - (1 << 64) if p >> 63 else p: k for k, p in enumerate(prints)}
    want = roots(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    for bucket in (5, 2048):
        found = simhash.links(df, bucket=bucket).collect()
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in found)
        assert roots(len(prints), [(place[r.a], place[r.b]) for r in found]) == want


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 500, np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64))
    apart = np.abs(simhash.distance_table(a, simhash.pivots()) - simhash.distance_table(b, simhash.pivots())).max(axis=1)
    assert apart.max() <= 2


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, k) for k in range(1001, 1300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain + star + [(5, 5), (3, 2)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1300)}


# --- quality rules

def brute_facts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_counts_and_verdicts(spark):
    rows = texts_of(spark) + [(500, None), (501, ""), (502, "a b c " * 40000), (503, "é\x85ñ \x1c | #\n\n#"), (0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("pattern", F.lit(1))
    out = quality.quality(df).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == (
        collections.Counter((i, *brute_facts(t)) for i, t in rows))
    assert all(r.kept == (not r.base_failed and r.good_probability >= 0.5) for r in out)
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    judged = [(quality_of[r.doc_id], r.kept) for r in out if r.doc_id in quality_of and not r.base_failed]
    assert sum(q == k for q, k in judged) >= 0.97 * len(judged)
    assert quality.quality(df.limit(0)).count() == 0


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    on_good, on_bad = np.array([0.99, 0.95, 0.98, 0.97]), np.array([0.8, 0.6, 0.9, 0.7])
    right = rng.random((20000, 4)) < np.where(truth[:, None], on_good, on_bad)
    votes = np.where(right == truth[:, None], 1, 2) * (rng.random((20000, 4)) < 0.9)
    pats = [quality.pattern(v) for v in votes.tolist()]
    share, acc, post = quality.estimate(collections.Counter(pats), 4)
    assert share == pytest.approx(0.8, abs=0.03)
    assert np.array(acc)[:, 0] == pytest.approx(on_good, abs=0.03) and np.array(acc)[:, 1] == pytest.approx(on_bad, abs=0.06)
    assert np.mean([(post[p] >= 0.5) == t for p, t in zip(pats, truth)]) > 0.95


# --- language id

def test_language_id_on_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(5000, None, "en"), (5001, "", None), (5002, "12 ! 34", "de"), (None, "the and of the", None), (0, "der die und", "fr")], "doc_id long, text string, lang string")
    out = langid.identify(df.select("doc_id", "text", "lang").unionByName(extra).withColumn("score", F.lit("clash"))).collect()
    assert len(out) == 1005
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    long = [r for r in out if r.held_out and r.text and len(r.text) > 100]
    assert sum(r.lang_pred == r.lang for r in long) >= 0.98 * len(long) and len(long) > 150
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (5000, 5001, 5002)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred for r in langid.identify(df.select("doc_id", "text").withColumn("lang", F.lit(None).cast("string")).limit(2)).collect()] == ["und", "und"]
    assert langid.identify(df.limit(0)).count() == 0


def test_every_text_with_a_letter_has_a_language(spark):
    vector = langid.vectors(512).bundle(*langid.trigrams("the and of the"))
    texts = [chr(c) * 3 for c in range(0x4e00, 0x4e40)] + ["q", "12 !", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    out = [r.p for r in df.select(langid.predicted(spark, F.col("text"), {"en": vector}).alias("p")).collect()]
    assert [p.lang_pred for p in out] == ["en"] * 65 + ["und"] * 2
    assert all(0 <= p.score <= 1 for p in out) and min(p.score for p in out[:65]) == 0


def test_bundles_follow_the_definition():
    v = langid.Vectors(64)
    text = "Ab, añ"
    code = [ord(c) for c in " ab añ "]
    want = sum(np.roll(v.of_letter(a), 2) * np.roll(v.of_letter(b), 1) * v.of_letter(c) for a, b, c in zip(code, code[1:], code[2:]))
    assert (v.bundle(*langid.trigrams(text)) == want).all()


# --- urls

def brute_verdict(url, rules, listed):
    head, sep, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest if sep else "", re.S)
    host, path = m[1].translate(LOWER), m[2]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), len(h), v == "allow", h + p) for v, h, p in rules if host and under(h) and path.startswith(p)]
    names = [(len(h), h) for h in listed if host and under(h)]
    rule = max(fits)[3] if fits else None
    verdict = ("allow" if max(fits)[2] else "block") if fits else "block" if names else "allow"
    return host, path, rule, verdict, max(names)[1] if names else None


def test_urls_brute_force(spark):
    some = [r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    some += [None, "", "no scheme", "http://", "HTTP://WWW.Spam-Farm.Example.ORG", "https://EXAMPLE.org/es/x?y", "http://a.example.org/en/19#z", "x://com/fr/", "x://notcom/fr/",
             "http://spam-farm.example.org?q=/es/", "http://ads-track.example.com//", "a://b://com/de/1", "http://" + "a." * 3000 + "com/de/" + "p" * 5000, "http://é.org/\nx", "http://com./fr/"] + some[:2]
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(some)], "page_id long, url string, verdict int")
    rules = spark.createDataFrame(list(URL_RULES), "verdict string, host string, path string")
    hosts = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed_host) for r in urls.judge_urls(df, rules, hosts).collect()}
    assert got == {k: brute_verdict(u, URL_RULES, LISTED_HOSTS) for k, u in enumerate(some)}
    assert {r.verdict for r in urls.judge_urls(df, rules.limit(0), hosts.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0), rules, hosts).count() == 0


def test_cascade_is_exact_over_several_levels_and_shards(spark, monkeypatch):
    keys = spark.range(20000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"))
    inside = keys.filter("pmod(xxhash64(host), 7) = 0")
    universe = keys.select(urls.key_hash(F.col("host"), F.col("path")).alias("h")).select("h.*")
    monkeypatch.setattr(urls, "MAX_BITS", 1 << 13)
    cascade = urls.Cascade.build(inside, universe)
    assert len(cascade.shards) > 1 and max(map(len, cascade.shards)) > 1
    asked = keys.withColumn("keys", F.array(F.struct("host", "path")))
    out = urls.with_membership(asked, "keys", cascade, "yes").select((F.get("yes", F.lit(0)) == F.expr("pmod(xxhash64(host), 7) = 0")).alias("ok"))
    assert out.filter("ok").count() == 20000


# --- archives

def test_archives_round_trip(spark, tmp_path):
    rnd = random.Random(4)
    html_of = lambda: "<p>" + " ".join(rnd.choice(["ab", "né", "x\r\n\r\ny", "WARC/1.1"]) for _ in range(rnd.randrange(60))) + "</p>"
    rows = [(k, f"http://x/{k}\r\nEvil: 1", html_of(), 1) for k in range(200)]
    rows += [(300 + k, None, rows[k % 3][2], 1) for k in range(60)] + [(400, "u", None, 1), (401, "u", "", 1), (402, "u", "z" * 300000, 1), rows[9], (None, "u", rows[1][2], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(4)
    manifest, folder = warc.write_archives(df, folder=str(tmp_path / "a"))
    back = warc.read_archives(spark, manifest, folder).collect()
    least = {}
    for i, _, h, _ in rows:
        least.setdefault(h or "", []).append(-1 if i is None else i)
    want = collections.Counter()
    for i, _, h, _ in rows:
        payload, first = (h or "").encode(), min(least[h or ""])
        name = lambda x: "null" if x in (None, -1) else str(x)
        revisit = first != (-1 if i is None else i)
        want[name(i), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response",
             name(first) if revisit else None, None if revisit else payload] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back) == want
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    first = manifest.orderBy(F.desc("records")).first()
    raw = (tmp_path / "a" / first.file).read_bytes()
    import zstandard
    dictionary = warc.read_dictionary(stream := io.BytesIO(raw))
    at, n = stream.tell(), 0
    packer = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    while at < len(raw):  # every record is a frame of its own
        one = packer.decompressobj()
        assert one.decompress(raw[at:]).startswith(b"WARC/1.1\r\n") and one.eof
        at, n = len(raw) - len(one.unused_data), n + 1
    assert n == first.records
    manifest, folder = warc.write_archives(df.limit(0), folder=str(tmp_path / "b"))
    assert warc.read_archives(spark, manifest, folder).count() == 0


def test_archive_folder_is_what_spark_means(spark):
    """A folder without a scheme belongs to the default file system, which need not be the local disk."""
    conf = spark._jsc.hadoopConfiguration()
    assert warc.qualified(spark, "/shared/ckpt") == "file:/shared/ckpt"
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://127.0.0.1:1")
    try:
        assert warc.qualified(spark, "/shared/ckpt") == "hdfs://127.0.0.1:1/shared/ckpt"
    finally:
        conf.set("fs.defaultFS", before)
    df = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>")], "page_id long, url string, html string")
    manifest, folder = warc.write_archives(df)
    assert folder.startswith("file:") and run_folder(spark) in folder and warc.read_archives(spark, manifest, folder).count() == 1


def test_items_in_passes_of_bounded_words(spark):
    rnd = random.Random(1)
    items = [(k, " ".join(f"w{rnd.randrange(999)}" for _ in range(30))) for k in range(8)] + [(99, None)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items if t], "doc_id long, text string")
    of = spark.createDataFrame(items, "item_id long, text string")
    got = [{(r.doc_id, x.item_id) for r in decontam.with_leaks(docs, of, max_words=n).collect() for x in r.leaks} for n in (60, 1 << 20)]
    assert got[0] == got[1] == {(k, k) for k in range(8)}


# --- page text

PAGES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain   text", "plain text"), ("<html><body>a<p>b<p>c</body></html>", "a\nb\nc"),
    ("<body><nav><a href=x>Menu entry</a></nav><article><header><h1>Ti&amp;tle</h1><p>by line</p></header><p>One <b>two</b>\n three<br>four<p>Five&nbsp;six"
     "<aside>side</aside><form><input>form</form><ul><li>x<li>y</ul><div class='ad-box'>Buy</div><section id=comments><p>" + "reader talk " * 60 + "</section></article>"
     "<footer>foot</footer>", "Ti&tle\nOne two three four\nFive six\nx\ny"),
    ("<body><div class='top'><a href=1>Home</a> <a href=2>News</a> <a href=3>More of it</a></div><div id=post><h2>Head</h2><p>" + "long text here " * 20 + "</p><p>short.</p></div>"
     "<div class=cookie-notice>We use cookies " + "and more " * 40 + "</div><script>var x='<p>no</p>'</script><style>p{}</style></body>",
     "Head\n" + ("long text here " * 20).strip() + "\nshort."),
    ("<div class='main has-sidebar'><article><p>kept text</p></article></div>", "kept text"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article><p>" + "w " * 200000 + "</article>", ("w " * 200000).strip()),
]


def test_page_text(spark):
    for page, want in PAGES:
        assert html.extract(page) == want, page and page[:300]
    df = spark.createDataFrame([(k, h, 5) for k, (h, _) in enumerate(PAGES)] + [(0, None, 5)], "page_id long, html string, n_chars int")
    out = html.main_text(df).collect()
    assert len(out) == len(PAGES) + 1 and all(r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text) for r in out)
    assert html.main_text(df.limit(0)).count() == 0


def test_forms_and_heads_keep_the_page():
    story = "<p>" + "long text here " * 20 + "</p>"
    want = ("long text here " * 20).strip()
    assert html.extract(f"<body><form id=aspnetForm><input type=hidden><input><div id=post>{story}{story}</div></form></body>") == want + "\n" + want
    assert html.extract(f"<body><form><input><article><h1>Title</h1>{story}</article></form></body>") == "Title\n" + want
    assert html.extract(f"<body><article>{story}<form><label>Your name please</label><input></form></article></body>") == want
    assert html.extract(f"<html><head><title>T</title><meta charset=utf-8><script>x()</script>{story}{story}") == want + "\n" + want
    assert html.extract("<head><title>T</title>bare text") == "bare text"


def test_siblings_and_marked_articles():
    one, two, talk = "long text here " * 20, "more text there " * 15, "reader talk " * 60
    for tag in ("article", "div"):  # a story in two parts is whole, whatever holds the parts
        page = f"<body><main><{tag}><p>{one}</p></{tag}><{tag}><p>{two}</p></{tag}></main></body>"
        assert html.extract(page) == one.strip() + "\n" + two.strip()
    comments = f"<section class=comments><article class=comment><p>{talk}</p></article></section>"
    assert html.extract(f"<body><article><p>{one}</p>{comments}</article></body>") == one.strip()
    assert html.extract(f"<body><div><p>{one}</p></div>{comments}</body>") == one.strip()
    assert html.extract(f"<body><article><h1>T</h1><div><p>{one}</p><p>{two}</p></div></article></body>") == "T\n" + one.strip() + "\n" + two.strip()
    assert html.extract(f"<body><article class=share><h1>T</h1><p>{one}</p></article></body>") == "T\n" + one.strip()


def test_density_prefers_text_over_links():
    root = html.parse("<body><div><a href=1>aaaa aaaa</a><a href=2>bbbb bbbb</a></div><div><p>plain words that are no link at all</p></div></body>")
    html.measure(root)
    links, text = root.children[0].children
    assert links.density < text.density and root.children[0].total == pytest.approx(links.density + text.density)


# --- decontamination

def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item):
        new = [k + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_best_place_is_the_edit_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, text = (rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(2))
        assert decontam.best_place(item, text)[0] == brute_edits(item.tolist(), text.tolist())


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 6, 12, 25, 40, 60])))) for k in range(25)]
    docs = []
    for k in range(160):
        body = [rnd.choice(vocab) for _ in range(rnd.randrange(60))]
        if k % 2:
            words = items[k % 25][1].split()
            for _ in range(rnd.randrange(int(len(words) * 0.3) + 1)):
                p = rnd.randrange(len(words))
                words[p:p + rnd.randrange(2)] = [rnd.choice(vocab)] * rnd.randrange(2)
                words = words or ["x"]
            body[rnd.randrange(len(body) + 1):0] = [w.upper() + "!" for w in words]
        docs.append((k, " \n".join(body)))
    want = set()
    for i, t in docs:
        words = re.findall(r"[a-z0-9]+", t.lower())
        for j, x in items:
            if brute_edits(x.split(), words) <= len(x.split()) // 5:
                want.add((i, j))
    docs += [(900, None), (901, ""), docs[1], (None, items[0][1])]
    items += [(900, None), (901, " ? ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("leaks", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks_of(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found if r.doc_id is not None}
    assert not got - want and len(got) >= 0.99 * len(want)
    assert {(r.doc_id, r.item_id) for r in found if r.edits == 0} >= {(None, 0)}
    clean = decontam.clean(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs if i is not None} - {i for i, _ in got}
    some = decontam.with_leaks(df, bench, max_items=10).select(F.size("leaks").alias("n")).agg(F.sum("n")).first()[0]
    assert some == len(found)
    assert decontam.leaks_of(df.limit(0), bench).count() == 0 and decontam.leaks_of(df, bench.limit(0)).count() == 0


def test_all_queries_cover_their_tables(spark):
    n = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, t in (("op3_url_filters", "pages"), ("op4_warc", "pages"), ("op9_html_density", "pages"), ("op10_language_id", "documents")):
        assert QUERIES[name](spark, SF_DIR).count() == n[t]
