"""Periodic runs and the conversation trie against brute-force versions."""

import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from strandframe.llm import runs, trie
from strandframe.llm.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs

def brute_runs(words, least=24):
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            e = i + q
            part = words[s:e]
            if e - s >= max(least, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted((s, n, q) for s, n, q in out)


def brute_planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def brute_digest(words):
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def drawn_words(draw):
    kind = draw.randrange(5)
    if kind == 0:
        return [str(draw.randrange(2)) for _ in range(draw.randrange(200))]
    if kind == 1:
        out = []
        for _ in range(draw.randrange(1, 5)):
            part = [str(draw.randrange(draw.choice([2, 3, 50]))) for _ in range(draw.randrange(1, 60))] * draw.randrange(1, 8)
            out += [str(draw.randrange(3)) for _ in range(draw.randrange(10))] + part[:len(part) - draw.randrange(20)]
        return out
    if kind == 2:  # Fibonacci words hold the most runs
        a, b = ["a"], ["a", "b"]
        while len(b) < draw.randrange(50, 400):
            a, b = b, b + a
        return b
    part = (["x"] * draw.randrange(1, 40) + ["y"] * draw.randrange(1, 4)) * draw.randrange(2, 6)
    return part if kind == 3 else ((part + ["z"] * draw.randrange(3)) * draw.randrange(2, 5))[:900]


def test_runs_of_drawn_words_brute_force():
    draw = random.Random(3)
    for _ in range(60):
        texts = [drawn_words(draw) for _ in range(draw.randrange(1, 10))]
        for words, found in zip(texts, runs.runs_of(texts)):
            assert [tuple(x) for x in found.tolist()] == brute_runs(words), words


def test_runs_of_long_texts():
    words = (["a"] * 99 + ["b"]) * 3000
    found = {tuple(x) for x in runs.runs_of([words])[0].tolist()}
    assert found == {(100 * k, 99, 1) for k in range(3000)} | {(0, 300_000, 100)}
    part = [str(k) for k in range(70_000)]
    assert runs.runs_of([["x"] + part * 3 + ["y"]])[0].tolist() == [[1, 210_000, 70_000]]


def test_synchronising_positions_depend_on_their_context_only():
    import numpy as np
    draw = np.random.default_rng(1)
    ids = draw.integers(0, 3, 4000)
    at, t = 700, 16
    again = np.concatenate((draw.integers(0, 3, 333), ids[at:at + 1500], draw.integers(0, 3, 500)))
    hashes = lambda x: runs._doubled(runs._doubled(runs._doubled(runs._doubled(runs._mixed(x.astype(np.uint64)), 1), 2), 4), 8)
    one = runs.synchronising(hashes(ids), t, np.zeros(len(ids) - t + 1, bool))
    two = runs.synchronising(hashes(again), t, np.zeros(len(again) - t + 1, bool))
    inside = lambda x, shift: {int(p) - shift for p in x if shift <= p < shift + 1500 - 2 * t}
    assert inside(one, at) == inside(two, 333) and len(inside(one, at)) > 1500 / t


def test_periodic_runs_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    want = {i: brute_digest(brute_planted(i, t)) for i, t in rows}
    assert got == want and sum(w[0] > 0 for w in want.values()) >= len(rows) // 20


def test_periodic_runs_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Na na " * 20), (4, "Na na " * 20), (None, "é   " * 30), (5, "w" * 100_000 + " v" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    got = collections.Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in out.collect())
    assert got == collections.Counter([
        (1, (), ""), (2, (), ""), (3, (), ""), (4, ((0, 40, 2),), "Na na"), (4, ((0, 40, 2),), "Na na"), (None, ((0, 60, 2),), "é  "),
        (5, ((1, 30, 1),), "w" * 100_000 + " v")])
    assert runs.periodic_runs(df.limit(0)).count() == 0


# --- conversation trie

def brute_trie(conversations):
    """Nodes of a dict id -> list of (role, text)."""
    members = collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return collections.Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items())


def grouped(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in out.items()}


def brute_heads(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conversations.get(c - c % 100, [])[:h] + turns[h:]
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    return collections.Counter(tuple(r) for r in df.select(*NODE).collect())


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(QUERIES["op12_prefix_trie"](spark, SF_DIR)) == brute_trie(brute_heads(grouped(rows)))


def test_trie_in_shards(spark):
    draw, rows = random.Random(4), []
    for c in range(400):  # many share heads, a third are copies of one
        turns = ["same", "again"] if c % 3 == 0 else [draw.choice("ab") * draw.randrange(1, 3) for _ in range(draw.randrange(1, 7))]
        rows += [(c, k if k else None, draw.choice(["user", None]) if c % 3 else "user", t) for k, t in enumerate(turns)]
    rows += [(None, 0, "user", "left out"), (5, 9, "user", None), (5, 9, "user", None), (900, 3, None, None), (901, 1, "user", "x" * 300_000)]
    rows += [(7777, k, "user", str(k % 2)) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash"))
    want = brute_trie(grouped(r for r in rows if r[0] != 7777))
    some = df.filter("conv_id is null or conv_id <> 7777")
    for size in (40, 100_000):  # some 30 shards, and one
        assert nodes(trie.prefix_trie(trie.number_turns(some), size)) == want
    assert trie.prefix_trie(trie.number_turns(df)).agg(F.max("depth")).first()[0] == 3000
    assert trie.prefix_trie(trie.number_turns(df.limit(0))).count() == 0
    assert nodes(trie.prefix_trie(trie.share_heads(trie.number_turns(some)), 40)) == brute_trie(brute_heads(grouped(r for r in rows if r[0] != 7777)))


def test_trie_of_turnless_conversations(spark):
    # the base conversation 300 is not there, so all of a short head is cut and nothing put in its place
    rows = [(c, 0, "user", "hello") for c in range(301, 310)]
    conversations = brute_heads(grouped(rows))
    assert [] in conversations.values()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(trie.prefix_trie(trie.share_heads(trie.number_turns(df)))) == brute_trie(conversations)


def test_nodes_with_their_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, None, "there"), (2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.with_turns(trie.prefix_trie(trie.number_turns(df)), df)
    assert {(r.depth, r.role, r.text) for r in got.collect()} == {(0, None, None), (1, "user", "hi"), (2, "", "there")}
