"""Operators 11 to 13 against brute force, and on odd input."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayguard.llm import merkle, nra, path_templates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("item", "score", "rank", "task", "n", "terms", "tree", "pos", "size", "digest", "leaf", "root", "host", "path", "node", "shape", "verdict", "_tampered")


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


# ---- 11 -------------------------------------------------------------------------------------------

def brute_ranked(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(nra.UPPER, nra.LOWER)
    counts = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    queries = {}
    for q, text in items:
        queries.setdefault(q, set()).update(term.findall((text or "").translate(lower)))
    out = []
    for q, terms in queries.items():
        scores = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "née", "x²", "日本語", "THE", "the"]
    rows = [(i, " ".join(rng.choice(words[:rng.choice([8, 66])]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    rows += [(5, rows[5][1]), (n, None), (n + 1, ""), (n + 2, "--- !"), (None, rows[7][1]), (n + 3, "the " * 400_000 + "w1"), (n + 4, "a\x00b_w1`w2{w3\x7fw4\x85w5")]
    return rows


def test_ranking_meets_brute_force(spark, monkeypatch):
    rows = texts(1, 220)
    items = [(q, rows[q * 7][1]) for q in range(12)] + [(3, "née日 THE 日本語"), (50, None), (51, "?"), (52, "nothing like it"), (None, "w1 w2"), (0, rows[0][1])]
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3))
    queries = clashing(spark.createDataFrame(items, "item_id long, text string"))
    want = brute_ranked(rows, items, 9)
    assert sorted(map(tuple, nra.ranked(docs, queries, 9).collect()), key=str) == want
    monkeypatch.setattr(nra, "SHARD", 17)  # many shards to a task, and queries in blocks
    monkeypatch.setattr(nra, "TASKS", 2)
    assert sorted(map(tuple, nra.ranked(docs, queries, 9, block_terms=20).collect()), key=str) == want
    assert nra.ranked(docs.limit(0), queries).count() == nra.ranked(docs, queries.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_reads_settle_ties_and_scores(seed, monkeypatch):
    monkeypatch.setattr(nra, "FIRST_READ", 4)
    rng = np.random.default_rng(seed)
    n, vocabulary = 500, 12
    sets = [np.sort(rng.choice(vocabulary, rng.integers(0, 6), replace=False)) for _ in range(n)]
    tfs = [rng.integers(1, 3, len(s)) for s in sets]
    length = np.full(n, 10) if seed % 2 else rng.integers(5, 30, n)
    lists = nra.Lists(length, np.array([len(s) for s in sets]), np.concatenate(sets), np.concatenate(tfs), n, int(length.sum()), vocabulary)
    weights = rng.integers(0, 4, vocabulary) * 1000
    query = np.array([0, 2, 3, 5, 7, 11])
    m = 50 + 50 * length * n // int(length.sum())
    exact = np.array([sum(int(weights[t]) * ((10 ** 9 * int(c)) // (1000 * int(c) + 20 * int(m[d]))) for t, c in zip(sets[d], tfs[d]) if t in query) for d in range(n)])
    for k in (1, 10, 600):
        docs, scores, _ = lists.best(query, weights, 0, k)
        assert (exact[docs] == scores).all()
        order = np.lexsort((docs, -scores))[:k]
        order = order[scores[order] > 0]
        want = np.lexsort((np.arange(n), -exact))[:k]
        assert docs[order].tolist() == want[exact[want] > 0].tolist()


def test_reading_stops_before_the_ends():
    """One document heads both lists, the rare heavy one and the long light one: what is met late is out by its bound."""
    n = 50_000
    lists = nra.Lists(np.arange(n) % 50 + 1, np.r_[2, np.ones(n - 1, np.int64)], np.r_[0, np.ones(n, np.int64)], np.r_[1, 50, np.ones(n - 1, np.int64)], n, n * 25, 2)
    docs, scores, read = lists.best(np.array([0, 1]), np.array([9000, 10]), 0, 1)
    assert docs.tolist() == [0] and read < n / 10


# ---- 12 -------------------------------------------------------------------------------------------

def judge(spark, urls, **kw):
    df = clashing(spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id long, url string, html string").drop("host", "path"))
    return [r for r in path_templates.judged(df, **kw).orderBy("page_id").collect()]


def test_rules_and_odd_urls(spark):
    urls = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://x.example.org/en/2", "http://b.com/fr/a", "http://b.com/de/a", "http://xexample.org/es/", "http://c.net",
            "HTTP://b.com?/fr/", "no scheme", None, "", "://", "a://b.com/de/x://c.org/", "http://b.com/de", "http://É.com/fr/", "http://d.net/" + "a/" * 40_000, "http://c.net"]
    got = judge(spark, urls)
    assert [(r["host"], r["path"], r["rule"]) for r in got[:15]] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("x.example.org", "/en/2", "org/"), ("b.com", "/fr/a", "com/fr/"),
        ("b.com", "/de/a", "com/de/"), ("xexample.org", "/es/", "org/"), ("c.net", "", None), ("b.com", "", None), ("", "", None), ("", "", None), ("", "", None), ("", "", None),
        ("b.com", "/de/x://c.org/", "com/de/"), ("b.com", "/de", None), ("É.com", "/fr/", "com/fr/")]
    assert [r["verdict"] for r in got[:6]] == ["block", "block", "allow", "allow", "block", "allow"]
    assert got[15]["path"] == "/" + "a/" * 40_000 and got[15]["template"].endswith("/a/a/**") and len(got) == len(urls)
    assert got[6]["verdict"] == got[16]["verdict"] == "allow"
    assert judge(spark, []) == []


def test_templates_generalise_merge_and_reject(spark):
    rules = [("block", "h.net", "/spam/1"), ("allow", "h.net", "/news/1")]
    urls = [f"http://h.net/spam/{i}" for i in range(100, 160)] + [f"http://h.net/spam/{i}" for i in range(200, 240)]
    urls += [f"http://h.net/news/{i}" for i in range(100, 160)] + [f"http://h.net/{s}/{i}" for s in ("sports", "culture") for i in range(30)]
    urls += [f"http://h.net/wiki/title-{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    got = {r["path"]: r for r in judge(spark, urls, rules=rules)}
    assert got["/spam/205"]["verdict"] == "block" and got["/spam/205"]["rule"] is None  # by its template
    assert got["/news/150"]["verdict"] == "allow" and got["/culture/3"]["verdict"] == "allow"
    assert got["/spam/205"]["template"] == got["/spam/110"]["template"] and got["/spam/205"]["template"].endswith("/*")
    assert got["/sports/1"]["template"] == got["/culture/2"]["template"] == "/*:mixed:wild/*"  # alike: one branch
    assert {got[p]["template"].rsplit("/", 1)[1] for p in got if p.startswith("/wiki/")} == {"*"}  # wide and rare: variable
    assert got["/spam/205"]["purity"] > 0.8 > got["/culture/3"]["purity"]


# ---- 13 -------------------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climb(digests, walkers):
    """Root of a list, and for each place its siblings level by level and how to fold them."""
    steps = [[] for _ in digests]
    at = {i: i for i in walkers}
    while len(digests) > 1:
        for i in at:
            run = at[i] // 3 * 3
            steps[i].append(("".join(digests[run:at[i]]), "".join(digests[at[i] + 1:run + 3])))
            at[i] //= 3
        digests = [sha(*digests[j:j + 3]) for j in range(0, len(digests), 3)]
    return digests[0], steps


def brute_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources}
    tops = {s: climb([leaf_of(r) for r in trees[s]], range(len(trees[s]))) for s in sources}
    root, across = climb([tops[s][0] for s in sources], range(len(sources)))
    out = []
    for k, s in enumerate(sources):
        for row, steps in zip(trees[s], tops[s][1]):
            now = row
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                now = (row[0], row[1].replace("\n", ""), *row[2:])
            digest, siblings = leaf_of(now), ""
            for left, right in steps + across[k]:
                digest, siblings = sha(left, digest, right), siblings + left + right
            out.append((row[0], leaf_of(row), tops[s][0], root, sha(siblings), digest, digest == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows, parts=3):
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(parts))
    return sorted(map(tuple, merkle.manifest(docs, merkle.newlines_cut(docs)).collect()), key=str)


def test_manifest_meets_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a\nb", "plain", "", "é\n" * 5, None]), rng.choice(["en", None]), s, rng.choice([3, None]))
            for s, n in ((None, 4), ("one", 1), ("zwei", 2), ("dreizehn", 13), ("Z", 28), ("é", 9), ("long", 1500)) for i in rng.sample(range(10 ** 6), n)]
    rows += [(7, "same\n", "en", "twice", 5), (7, "same\n", "en", "twice", 5), (7, "other", "en", "twice", 5), (None, "no id\n", "en", "twice", 1), (8, "x\n" * 100_000, "en", "twice", 1)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_small_manifests(spark, n):
    rows = [(i, "t\n", "en", None, 2) for i in range(n)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_many_sources_and_none(spark, monkeypatch):
    monkeypatch.setattr(merkle, "KEPT", 2)  # more stored levels; workers get the value with the function
    rows = [(i, "t\n", "en", f"s{i % 40:02d}", 2) for i in range(200)]
    assert manifest_rows(spark, rows[:0]) == []
    assert merkle.steps(10) == 2
