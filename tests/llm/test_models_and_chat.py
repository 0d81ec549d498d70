from __future__ import annotations

import duckdb
import numpy as np
import pytest
from conftest import SMOKE
from pyspark.sql import functions as F

from stayguard.llm import multi_index, preference, toxicity

SF = SMOKE.replace("0.001", "0.01")


def test_gradients_meet_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    px, y = rng.standard_normal((6, 3, 6 * toxicity.HIDDEN)), np.array([1, 0, 1.0])
    mask = np.arange(6)[:, None] < np.array([6, 4, 2])[None, :]

    def loss():
        return float(np.sum(np.log1p(np.exp(-(2 * y - 1) * net.forward(px, mask)[0]))))

    _, g, dpx = net.gradients(px, mask, lambda logit: 1 / (1 + np.exp(-logit)) - y)
    for name in ("uf", "ub", "a", "ab", "av", "o", "ob"):
        flat, grad = net.w[name].ravel(), np.asarray(g[name]).ravel()
        i = int(np.argmax(np.abs(grad)))
        old = flat[i]
        flat[i] = old + 1e-3
        up = loss()
        flat[i] = old - 1e-3
        down = loss()
        flat[i] = old
        assert grad[i] == pytest.approx((up - down) / 2e-3, rel=0.05)


def test_windows_cover_every_token_and_overlap():
    text = " ".join(f"t{i}" for i in range(101)).encode()
    offsets = np.array([0, len(text), len(text), len(text) + 3])
    tokens = toxicity.Tokens(np.frombuffer(text + b"a b", np.uint8), offsets)
    owner, start, lens = tokens.windows()
    seen = np.zeros(103, int)
    for s, n in zip(start, lens):
        seen[s:s + n] += 1
    assert seen.min() >= 1 and (seen[16:85] >= 2).all() and owner.tolist().count(1) == 0


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(caught) / len(caught) > 0.7
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) == 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = spark.read.parquet(f"{SMOKE}/documents.parquet"), spark.read.parquet(f"{SMOKE}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.scored(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    for labels, want in (([(1, 0)], 0.0), ([], 0.0), ([(1, 1)], 1.0)):
        got = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert {r["score"] for r in got} == {want}


def test_pairs_meet_sql(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a1"), (1, 3, "user", "more"), (1, 4, "assistant", "a2"),
            (2, 0, "system", "s"), (2, 1, "user", "other"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "a1 \U0001f600"),
            (4, 0, "system", "s"), (4, 1, "user", "q"), (4, 2, "assistant", "a1"), (4, 3, "user", "more"), (4, 4, "assistant", "a2"), (5, 0, None, None), (6, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference.preference_rows(df).toPandas().sort_values("pair_id").reset_index(drop=True)
    conversations = df.toPandas()  # noqa: F841  read by name below
    want = duckdb.sql(preference.SQL).df()[list(got.columns)].sort_values("pair_id").reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))
    row = got[got.pair_id == "opening:1:4"].iloc[0]
    assert row.n_common == 5 and row.chosen == row.rejected == ""
    row = got[got.pair_id == "stale:1"].iloc[0]
    assert row.prompt.endswith("<|user|>\nmore<|end|>\n") and row.rejected == "<|assistant|>\na1<|end|>\n"
    a, b = map(int, row.chosen_mask.split(":"))
    assert row.chosen[a:b] == "a2<|end|>\n"


def brute_nearest(rows, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
    return out


@pytest.mark.parametrize("share,recall", [(1.0, 1.0), (0.5, 0.9)])
def test_nearest_meet_brute_force(spark, share, recall):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16))
    x = [[float(np.float32(v)) for v in centres[i % 8] + 0.3 * rng.standard_normal(16)] for i in range(3000)]
    x[17:60] = [x[17]] * 43  # a group of copies that is larger than k
    x[400] = x[17]
    rows = list(enumerate(x))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in multi_index.searched(df, F.col("id") % 100 == 0, share=share, least=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert found >= recall
    if share == 1.0:
        assert got == want


def test_cells_come_in_order_of_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    counts = rng.integers(0, 3, 35)
    cells = multi_index.visited(a, b, counts, int(counts.sum()))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums) and set(cells) == set(np.flatnonzero(counts).tolist())
    assert counts[multi_index.visited(a, b, counts, 6)].sum() >= 6
