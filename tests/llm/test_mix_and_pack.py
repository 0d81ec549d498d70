from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SMOKE
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayguard.llm import flow_mix, pattern_pack, token_rollup
from stayguard.llm.tokens import ChunkTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_targets_share_by_weight_and_stop_at_three_times():
    t = flow_mix.targets({"a": 100, "b": 100, "c": 100, "d": 10, None: 0})
    assert t["d"] == 30 and t[None] == 0 and sum(t.values()) == pytest.approx(310)
    rest = 280 / 6
    assert [t[s] for s in "abc"] == pytest.approx([rest, 2 * rest, 3 * rest])
    assert flow_mix.targets({}) == {} and flow_mix.targets({"x": 0}) == {"x": 0.0}


def test_flow_is_cheapest():
    """Two sources share a pattern: the one with own words leaves the shared ones to the other."""
    flow = flow_mix.route({"A": 100, "AB": 50, "B": 10}, {"A": ["a"], "AB": ["a", "b"], "B": ["b"]}, {"a": 100, "b": 60})
    assert flow == {("A", "a"): 100, ("AB", "b"): 50, ("B", "b"): 10}
    flow = flow_mix.route({"A": 10}, {"A": ["a"]}, {"a": 1000})
    assert flow == {("A", "a"): 30}  # three uses at most
    flow = flow_mix.route({"A": 10, "AB": 10}, {"A": ["a"], "AB": ["a", "b"]}, {"a": 20, "b": 10})
    assert sum(v for (p, s), v in flow.items() if s == "a") == 20 and sum(flow.values()) == 30


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = {r["doc_id"]: r for r in flow_mix.mixed(df.repartition(7)).collect()}
    two = {r["doc_id"]: r["taken"] for r in flow_mix.mixed(df.repartition(2)).collect()}
    assert {k: r["taken"] for k, r in one.items()} == two
    by = Counter()
    for r in one.values():
        by[r["source"]] += r["taken"]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    for r in one.values():
        assert abs(by[r["source"]] - r["target"]) <= 60


def test_overlapping_members(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    taken = {r["doc_id"]: r["taken"] for r in flow_mix.mix(df, {"a": 500, "b": 500}).collect()}
    assert sum(taken.values()) == 1000 and set(taken.values()) == {10}


def brute(t):
    return BRUTE.encode(t or "", add_special_tokens=False).ids


BRUTE = Tokenizer.from_file(PATH)
CHUNKED = ChunkTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", "word,", "it's", "don't.", "12", "é", "É!", "İ", "Σ", "ﬁ", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\x85", "\x1c",
                                 "́", "a.,", "!!!!", "-", "日本", "x1,", "»,"]), max_size=12))
def test_chunk_ids_are_the_tokenizers_own(parts):
    text = "".join(parts).encode()
    ids, at = CHUNKED.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == brute("".join(parts))


def test_pieces_round_trip_and_packing_is_tight(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    cut = pattern_pack.pieces(docs, PATH, with_ids=True).collect()
    rebuilt = {}
    for r in sorted(cut, key=lambda r: (r["doc_id"], r["piece"])):
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["start"] == len(rebuilt.get(r["doc_id"], []))
        rebuilt.setdefault(r["doc_id"], []).extend(r["ids"])
    assert rebuilt == {d: brute(t) + [0] for d, t in texts.items()}
    rows = pattern_pack.packed(docs, PATH).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1 + 1.01 * sum(r["length"] for r in rows) / 2048


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_use_up_the_histogram(histogram):
    made = pattern_pack.plan(histogram, max_len=64, bins=16)
    used = Counter()
    for kind, k in made.items():
        assert sum(kind) <= 64
        for n in kind:
            used[n] += k
    assert used == Counter(histogram)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 30)), rng.random(20)
    x = pattern_pack.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max() < 1e-6


def test_rollup_commits_are_idempotent(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d e", "en", "s"), (3, "f", None, None)], "doc_id long, text string, lang string, source string")
    base = token_rollup.signed(docs, 1, "v1", token_rollup.word_tokens("text"))
    r = token_rollup.Rollup(spark)
    assert r.totals().count() == 0
    for _ in range(3):
        r.commit(1, base)
    gone = token_rollup.signed(docs.filter("doc_id = 3"), -1, "v1", token_rollup.word_tokens("text"))
    one = docs.filter("doc_id = 1")
    change = token_rollup.revised(token_rollup.signed(one, 1, "v1", F.lit(3)), token_rollup.signed(one, 1, "v2", F.lit(7)))
    for _ in range(2):
        r.commit(2, gone.unionByName(change))
    got = {(x["source"], x["lang"], x["version"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}
    assert got == {("s", "en", "v1"): (1, 2), ("s", "en", "v2"): (1, 7)}
    again = token_rollup.Rollup(spark, r.path)
    assert again.totals().count() == 2


def test_public_tokenizer_counts(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    got = {r["doc_id"]: r["tokens"] for r in token_rollup.counted(docs, PATH).collect()}
    assert got == {r["doc_id"]: len(brute(r["text"])) for r in docs.collect()}


def test_a_commit_that_dies_leaves_what_was_committed(spark, monkeypatch):
    from stayguard.operators import files
    rows = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], "source string, lang string, version string, sign long, tokens long")
    r = token_rollup.Rollup(spark)
    assert r.totals().count() == 0 and r.commit(1, rows(5)) and r.commit(2, rows(7))
    monkeypatch.setattr(files, "point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        r.commit(2, rows(100))  # written, not committed
    monkeypatch.undo()
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v", 2, 12)]
    r.commit(2, rows(9))
    assert r.totals().first()["n_tokens"] == 14


def test_old_batches_are_folded(spark, monkeypatch):
    from stayguard.operators import files
    monkeypatch.setattr(token_rollup, "FOLD_AT", 4)
    monkeypatch.setattr(token_rollup, "KEPT_OPEN", 2)
    r = token_rollup.Rollup(spark)
    for i in range(9):
        r.commit(i, spark.createDataFrame([("s", None, "v", 1, i)], "source string, lang string, version string, sign long, tokens long"))
    assert len(files.listed(spark, f"{r.path}/commits")) <= 4
    change = spark.createDataFrame([("s", None, "v", 1, 1000)], "source string, lang string, version string, sign long, tokens long")
    assert not r.commit(0, change) and [tuple(x) for x in r.totals().collect()] == [("s", None, "v", 9, 36)]
    r.commit(8, change)
    assert r.totals().first()["n_tokens"] == 1028
