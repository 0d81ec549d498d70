from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayguard.llm import robust_quality, secret_ownership
from stayguard.llm.bytewise import flat

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    three = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if three[x] > 1 for j in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, dup, len(covered)]


def test_counts_are_exact():
    rng = random.Random(4)
    parts = ["a", "b", "ab", "é", "\U0001f600", "#", "<>", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\r\n", "\x85", " ", "\xa0", "x y", "\x1c"]
    texts = [None, "", "\n", "a"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    got = np.stack(robust_quality.text_counts(*flat(pa.array(texts, pa.string()))), axis=1)
    assert got.tolist() == [brute_counts(t) for t in texts]


def test_chi_square():
    assert robust_quality.chi2_quantile(0.95, 1) == pytest.approx(3.841458821, rel=1e-8)
    assert robust_quality.chi2_quantile(0.975, 5) == pytest.approx(12.8325, rel=1e-4)
    assert robust_quality.consistency(0.999999, 5) == pytest.approx(1, abs=1e-3)


def test_outliers_do_not_move_the_estimate(spark):
    """A third of the rows of one group is far off; the estimate stays at the rest, and only they are rejected."""
    rng = np.random.default_rng(2)
    mean, spread = np.array([6.0, 1.5, 0.2, 0.3, 0.4]), np.array([0.8, 0.2, 0.2, 0.3, 0.3])
    good = rng.normal(mean, spread, (600, 5))
    bad = rng.normal(mean + [0, 0, 4, 0, 0], 0.05, (180, 5))
    rows = [("g", int(i % robust_quality.SALTS), *map(float, r)) for i, r in enumerate(np.vstack([good, bad]))]
    df = spark.createDataFrame(rows, "g string, salt int, " + ", ".join(f"z{i} double" for i in range(5)))
    e = robust_quality.fit(df).first()
    assert np.abs(np.array(e["mu"]) - good.mean(axis=0)).max() < 0.1
    cov = np.linalg.inv(np.array(e["inv"]).reshape(5, 5)) - np.diag(np.square(robust_quality.FLOORS))
    assert np.abs(np.sqrt(np.diag(cov)) / good.std(axis=0) - 1).max() < 0.25
    far = lambda x: np.einsum("ni,ij,nj->n", x - e["mu"], np.array(e["inv"]).reshape(5, 5), x - e["mu"])
    cut = robust_quality.chi2_quantile(robust_quality.REJECT, 5)
    assert (far(bad) > cut).all() and (far(good) > cut).mean() < 0.01


def test_labelled_quality(spark):
    from conftest import SMOKE
    sf = SMOKE.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = robust_quality.judged(docs).join(labels, "doc_id").filter("not base_failed")
    shares = {r["quality"]: r["s"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert shares[1] > 0.98 and shares[0] < 0.1


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_base_spans_are_exact(spark):
    rng = random.Random(9)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH1234567890",
             "x", "-", "hunter2hunter2", "\U0001f600", "é", "\n", ".", "AKIAAKIA", "ſecret=abcdefghijklmn", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in secret_ownership.scanned(df).collect():
        want = brute_spans(texts[r["doc_id"]] or "")
        named = ",".join(f"{secret_ownership.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("owned")] == [s for s in named.split(",") if s]


def test_owners_tell_examples_from_credentials(spark):
    example, mine, dull = "token=Ab3dEf6hIj9kLm2n", "q7Rt2ZxP9vLm4KwB8sYd", "zzzzzzzzzzzzzzzzzzzzzzzz1"
    rows = [(i, f"see {example} here", f"s{i}") for i in range(5)] + [(10, f"my key {mine} ok", "s1"), (11, f"again {mine}", "s1"), (12, dull, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r for r in secret_ownership.scanned(df).collect()}
    assert all(got[i]["n_example"] == 1 and got[i]["n_live"] == 0 and got[i]["spans"].startswith("assign") for i in range(5))
    assert got[10]["spans"] == "owned:7:27" and got[10]["n_live"] == 1 and got[11]["n_live"] == 1
    assert got[12]["spans"] == ""
    text = secret_ownership.scanned(df).join(df.select("doc_id", "text"), "doc_id").select("doc_id", secret_ownership.masked(F.col("text"), F.col("found")).alias("m"))
    out = {r["doc_id"]: r["m"] for r in text.collect()}
    assert out[10] == "my key <SECRET> ok" and out[0] == rows[0][1] and out[12] == dull


def test_spans_of_all_kinds_by_brute_force(spark):
    rng = random.Random(5)
    pieces = ["password = ", "token:'", "AKIA", "ABCDEFGH12", "0123456789abcdef", "deadbeef" * 2, "zZ9_" * 6, "plain words ", "\n", "é", "api_key=", "A1b2C3d4E5f6G7h8I9j0K", "=", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(n)) for n in (0, 3, 10, 40, 40, 300, 3000)]
    df = spark.createDataFrame([(i, t, f"s{i}", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    for r in secret_ownership.with_candidates(df, F.col("text")).collect():
        base, more = [], []
        for k, kind in enumerate(secret_ownership.KINDS):
            for m in re.finditer(secret_ownership.PATTERNS[kind], r["text"]):
                if len(m[1]) >= secret_ownership.LEAST[kind] and (kind != "owned" or re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])):
                    (more if kind == "owned" else base).append((m.start(), k, m.end()))
        want = base + [s for s in more if not any(s[0] < b[2] and b[0] < s[2] for b in base)]
        assert sorted((s["start"], s["kind"], s["end"]) for s in r["cands"]) == sorted(want)
    for t, i in zip(texts, range(len(texts))):  # masking against plain slicing
        spans = sorted((m.start(), 2, m.end(), rng.random() < 0.7) for m in re.finditer("[0-9a-f]{16,}", t))
        spans += [(s[0] + 3, 3, s[2] + 2, True) for s in spans[:1]]
        out, at = "", 0
        for a, _, z, live in sorted(spans):
            if live:
                out, at = (out + t[at:a] + "<SECRET>" if a >= at else out), max(at, z)
        one = spark.createDataFrame([(t, spans)], "text string, found array<struct<start:int,kind:int,end:int,live:boolean>>")
        assert one.select(secret_ownership.masked(F.col("text"), F.col("found"))).first()[0] == out + t[at:]


def test_time_grows_with_the_matches(spark):
    def seconds(n):
        text = " ".join(f"{i:08x}{i * 7919:024x} tok{i}A1b2C3d4E5f6G7h8" for i in range(n))
        df = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
        t0 = time.perf_counter()
        row = secret_ownership.scanned(df).withColumn("m", F.length(secret_ownership.masked(F.lit(text), F.col("found")))).first()
        assert row["n_hex"] == n and row["n_live"] > n // 2
        return time.perf_counter() - t0

    seconds(200)
    few, many = seconds(2_000), seconds(20_000)
    assert many < 10 * few + 30, (few, many)


def test_copies_within_few_owners_are_not_live(spark):
    value = "token=q8Zr2Lw9Xt4Vb7Nm3Kc6"
    rows = [(i, value, "one", f"l{i}") for i in range(secret_ownership.MAX_REPOSITORIES + 1)] + [(10, "token=m5Yp1Hs8Gd2Fj4Aq9Wz7", "one", "l0")]
    got = {r["doc_id"]: r for r in secret_ownership.scanned(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert (got[0]["n_live"], got[0]["n_shared"], got[0]["n_example"]) == (0, 1, 0) and (got[10]["n_live"], got[10]["n_shared"]) == (1, 0)
