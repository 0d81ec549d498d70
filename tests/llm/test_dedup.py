from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from stayguard.llm import radix_suffix, weighted_minhash
from stayguard.llm import bytewise as X


def brute_removed(rows):
    """Every 50-byte string of a text, looked up in all documents of smaller ids."""
    windows = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            windows.setdefault(b[i:i + 50], set()).add(d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if min(windows[b[i:i + 50]]) < d:
                gone[i:i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(20, 160))) for _ in range(12)]
    rows = [(rng.randint(1, 60), "".join(rng.choice(pool) for _ in range(rng.randint(0, 5)))) for _ in range(80)]
    return rows + [(99, "a" * 400), (98, "a" * 120), (97, "a" * 49), (96, "a" * 50), (3, pool[0] * 2), (3, pool[0] * 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_are_exact(spark, seed, monkeypatch):
    from stayguard.llm import blocks
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)  # many small blocks, many ranges
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = radix_suffix.removed(df, with_kept=True).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removed(rows)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_rolling_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abcabcXabc", np.uint8)
    h = X.hashes(data, np.array([0, 1, 3, 7]), np.array([3, 4, 6, 10]))
    assert h[0] == h[2] == h[3] != h[1]
    long = np.frombuffer(bytes(range(256)) * 9000, np.uint8)  # longer than what is summed at a time
    at = np.arange(0, len(long) - 256, 256)
    assert len(set(X.hashes(long, at, at + 200).tolist())) == 1 and X.hashes(long, np.array([0]), np.array([len(long)])).size == 1
    least = radix_suffix._least(np.arange(100, 0, -1).astype(np.uint64))
    assert least.tolist() == [100 - i - radix_suffix.SPAN + 1 for i in range(100 - radix_suffix.SPAN + 1)]


def test_samples_agree_as_often_as_vectors_are_similar():
    rng = np.random.default_rng(3)
    agree, similar = [], []
    for _ in range(60):
        keys = np.unique(rng.integers(0, 1 << 48, 300).astype(np.uint64))
        w = rng.uniform(0.5, 2, len(keys)).astype(np.float32)
        share = rng.uniform(0.5, 1)
        keep = rng.random(len(keys)) < share
        v = (w * rng.choice([1, 1, 1, 1.3], len(keys))).astype(np.float32)
        a, b = (keys, np.log(w)), (keys[keep], np.log(v[keep]))
        sa, sb = (weighted_minhash.samples(k, lw, np.array([0])) for k, lw in (a, b))
        agree.append((sa == sb).mean())
        low = np.minimum(w[keep], v[keep]).sum()
        similar.append(low / (w.sum() + v[keep].sum() - low))
    assert abs(np.mean(agree) - np.mean(similar)) < 0.02
    assert np.corrcoef(agree, similar)[0, 1] > 0.9


def brute_classes(rows, similarity):
    """All pairs, by weighted Jaccard over all shingles of distinct texts."""
    first = {}
    for d, t in rows:
        first[t] = min(d, first.get(t, d))
    vectors, df = {}, {}
    for t, d in first.items():
        w = t.split()
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
        v = {}
        for g in grams:
            v[g] = v.get(g, 0) + 1
        vectors[d] = v
        for g in v:
            df[g] = df.get(g, 0) + 1
    n = len(first)
    idf = {g: min(1.5, max(1, 1 + 0.5 * np.log((1 + n) / (1 + 2 ** (round(8 * np.log2(k)) / 8))) / np.log(1 + n))) for g, k in df.items()}
    label = {d: d for d in vectors}
    margin = []
    for a, b in itertools.combinations(sorted(vectors), 2):
        va, vb = ({g: c * idf[g] for g, c in vectors[x].items()} for x in (a, b))
        low = sum(min(va[g], vb[g]) for g in va.keys() & vb.keys())
        high = sum(va.values()) + sum(vb.values()) - low
        s = low / high if high else 0
        margin.append(abs(s - similarity))
        if s >= similarity:
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    return {d: label[first[t]] for d, t in rows}, min(margin)


def test_classes_meet_all_pairs(spark, monkeypatch):
    from stayguard.llm import blocks
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    rng = random.Random(10)
    rows, doc = [], 0
    for _ in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 200))]
        for k in range(6):
            words = list(base)
            for _ in range(k * len(base) // 60):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    rows += [(doc + i, t) for i, t in enumerate(("", "  ", "two words", "two words", rows[0][1], rows[7][1]))]
    want, margin = brute_classes(rows, 0.8)
    assert margin > 1e-3  # half floats do not decide
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.classes(df).collect()}
    assert got == want


def test_hubs_and_templates_meet_all_pairs(spark):
    """Edits that are near their base only, which is not the first of its buckets, and texts of one template."""
    rng = random.Random(4)
    texts = []
    base = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    for k in range(101):
        words = list(base)
        for i in rng.sample(range(400), 0 if k == 57 else 6):
            words[i] = f"x{rng.randint(0, 10 ** 6)}"
        texts.append(" ".join(words))
    fields = [[[f"f{i}v{v}n{n}" for n in range(9)] for v in range(3)] for i in range(8)]
    for _ in range(80):
        texts.append(" ".join(w for i in range(8) for w in [f"t{i}n{n}" for n in range(24)] + rng.choice(fields[i])))
    rows = list(enumerate(texts))
    want, margin = brute_classes(rows, 0.8)
    assert margin > 1e-4 and len({want[d] for d in range(101)}) == 1 and len({want[d] for d in range(101, 181)}) > 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in weighted_minhash.classes(df).collect()} == want


def test_texts_of_one_word_repeated_are_near(spark):
    """Weights beyond what a half float can hold."""
    rows = [(5, "spam " * 70_000), (3, "spam " * 72_000 + "end"), (4, "eggs " * 70_000), (7, "few other words are in this text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in weighted_minhash.classes(df).collect()} == {5: 3, 3: 3, 4: 4, 7: 7}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (301, 300)]
    df = spark.createDataFrame(links, "id long, rep long")
    got = {r["id"]: r["class_id"] for r in weighted_minhash.components(df).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {k: 100 for k in range(101, 160)} | {301: 300}
