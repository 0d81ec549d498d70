"""Every operator and stage on nulls in any column, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""
from __future__ import annotations

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stayguard.llm import (flow_mix, multi_index, pattern_pack, preference, radix_suffix, robust_quality, secret_ownership, token_rollup, toxicity,
                           weighted_minhash)

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} token=abcdefgh{i}xyz" if i % 500 == 0 else f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "a plain text of some ten words that says nothing much", "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (4, " \n\t ", "de", None),
    (5, LONG, "en", "s1"), (6, "a plain text of some ten words that says nothing much", "en", "s2"), (6, "a plain text of some ten words that says nothing much", "en", "s2"),
    (7, "one", None, None), (None, "a text without an id but with words in it", "fr", "s3"), (None, None, None, None), (8, "password = hunter2hunter2x", "en", "s1"),
    (9, "\U0001f600 é ß \x85   <|endoftext|> " * 3, "xx", "s1"), (10, "same same same same " * 40, "en", "s2"),
]
CLASH = ["id", "block", "size", "taken", "target", "part", "cell", "digest", "found", "score", "predicted", "g", "salt", "z0", "length", "piece", "members",
         "_pattern", "_text", "class_id", "first", "owner", "repo", "cands", "tokens", "version", "text_", "row_id"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in ROWS], SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def counts(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out[r[key]] = out.get(r[key], 0) + 1
    return out


WANT = {}
for _r in ROWS:
    WANT[_r[0]] = WANT.get(_r[0], 0) + 1


def test_one_row_for_each_document(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (10, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for work in (robust_quality.judged, secret_ownership.scanned, flow_mix.mixed, radix_suffix.removed, weighted_minhash.classes,
                 lambda d: toxicity.scored(d, labels)):
        assert counts(work(docs)) == WANT
        assert work(none).count() == 0


def test_defined_values(docs):
    q = {r["doc_id"]: r for r in robust_quality.judged(docs).collect() if r["doc_id"] is not None}
    assert q[2]["n_words"] == q[3]["n_words"] == q[4]["n_words"] == 0 and q[2]["base_failed"] and not q[2]["kept"]
    assert q[10]["n_repeat_words"] == 160 and q[10]["base_failed"] and q[5]["n_words"] == 60_000 + 120
    s = {r["doc_id"]: r for r in secret_ownership.scanned(docs).collect()}
    assert s[8]["n_assign"] == 1 and s[8]["spans"] == "assign:0:26" and s[2]["spans"] == "" and s[5]["n_assign"] > 50
    r = {x["doc_id"]: x for x in radix_suffix.removed(docs).collect() if x["doc_id"] is not None}
    assert r[6]["n_removed"] == r[6]["n_bytes"] > 50 and r[1]["n_removed"] == 0 and r[2]["n_bytes"] == 0
    c = {x["doc_id"]: x["class_id"] for x in weighted_minhash.classes(docs).collect()}
    assert c[1] == c[6] == 1 and c[5] == 5 and c[None] is None and c[2] == c[3] == 2 and c[4] == 4
    t = flow_mix.mixed(docs).collect()
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in t)


def test_pieces(docs, none):
    rows = pattern_pack.packed(docs, PATH).collect()
    assert {r["doc_id"] for r in rows} == set(WANT) and sum(r["length"] for r in rows if r["doc_id"] == 2) == 1
    assert max(r["piece"] for r in rows if r["doc_id"] == 5) > 20
    assert pattern_pack.packed(none, PATH).count() == 0


def test_rollups(docs, none):
    assert token_rollup.maintained(none).count() == 0
    assert token_rollup.maintained(docs).filter("source is null or lang is null").count() > 0
    assert sum(r["tokens"] for r in token_rollup.counted(docs, PATH).filter("doc_id = 2").select("tokens").collect()) == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, None), (None, 0, "user", "x"), (2, 0, None, None),
            (3, 0, "user", "x" * 100_000), (3, 1, "assistant", ""), (3, 2, "user", "more"), (3, 3, "assistant", "end")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "turns", "at", "pair_id")})
    got = {r["pair_id"]: r for r in preference.preference_rows(turns).collect()}
    assert set(got) == {"stale:1", "stale:3", "opening:1:2"} or "stale:3" in got
    assert got["stale:3"]["n_common"] == 3 and got["stale:3"]["chosen_mask"] == f"{len('<|assistant|>') + 1}:{len('<|assistant|>') + 1 + 3 + 8}"
    assert preference.preference_rows(turns.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]),
            (8, [1.0]), (None, [3.0, 3.0]), (9, [0.0, 2.0]), (10, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("id", "vector", "cell", "part", "score", "rank")})
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in multi_index.searched(v, F.lit(True)).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 0.0), (1, 2, 9, 5 ** 0.5), (2, 1, 1, 0.0), (2, 2, 9, 5 ** 0.5), (9, 1, 1, 5 ** 0.5), (9, 2, 2, 5 ** 0.5)]
    assert multi_index.searched(v.limit(0), F.lit(True)).count() == 0


def test_stages_keep_other_columns(spark, docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 1), (6, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(sf, "labels.parquet"))
    more = docs.withColumns({c: F.lit(c) for c in ("held_out", "times", "n", "_row", "w", "h")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in CLASH + ["held_out", "times", "n", "_row", "w", "h"])


def test_every_stage(spark, docs, none, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 1), (6, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(sf, "labels.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, plain, sf)
        if name != "pack":
            assert out.columns == plain.columns
        assert out.count() > 0
        assert stage(spark, plain.limit(0), sf).count() == 0
    left = counts(dict(corpus_pipeline.STAGES)["near_dedup"](spark, plain, sf))
    assert left[1] == 1 and 6 not in left and left[None] == 2 and left[5] == 1
    masked = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["secrets"](spark, plain, sf).collect()}
    assert masked[8] == "<SECRET>" and masked[1] == ROWS[0][1]
