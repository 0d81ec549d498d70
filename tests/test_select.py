"""Selection by counted cells against brute force, with cells cut again and again (small LIMIT)."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayguard.operators import rank as R
from stayguard.operators import select as S

LIMITS = [1_000_000, 40]


@pytest.fixture(params=LIMITS)
def limit(request, monkeypatch):
    monkeypatch.setattr(S, "LIMIT", request.param)
    monkeypatch.setattr(S, "FANOUT", 8 if request.param < 100 else 64)
    return request.param


def test_quantiles_meet_numpy(spark, limit):
    rng = np.random.default_rng(1)
    data = {"tied": np.repeat([1.0, 2.0, 3.0], [10, 300, 5]), "one": np.array([4.0]), "spread": rng.lognormal(3, 3, 400), "flat": np.zeros(50)}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("tied", None), (None, 1.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["q"] for r in S.exact_quantiles(df, "x", probs, partition_by=["g"]).collect()}
    want = {(g, p): float(np.quantile(xs, p)) for g, xs in {**data, None: np.array([1.0, 5.0])}.items() for p in probs}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert S.exact_quantiles(df.limit(0), "x", probs).count() == 0


def test_weighted_quantiles(spark, limit):
    rng = np.random.default_rng(2)
    xs, ws = rng.random(60), rng.integers(0, 9, 60)
    df = spark.createDataFrame([(float(x), int(w)) for x, w in zip(xs, ws)], "x double, w int")
    got = [r["q"] for r in S.exact_quantiles(df, "x", [0.1, 0.5, 0.77], weight=F.col("w")).orderBy("_i").collect()]
    assert got == pytest.approx(list(np.quantile(np.repeat(xs, ws), [0.1, 0.5, 0.77])))


def test_no_order_of_all_values_in_the_plan(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    plan = S.exact_quantiles(df, "x", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def brute_top(rows, share_rows):
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    return [sum(r[2] for r in order[:k]) for k in share_rows]


def test_top_sums_meet_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    rows = [(f"b{i:04d}", [0.5, None, float(rng.integers(0, 9)) / 8, float(rng.random())][i % 4], int(rng.integers(0, 5)), "hot" if i % 3 else "cold") for i in rng.permutation(600)]
    df = spark.createDataFrame(rows, "id string, s double, m int, g string").repartition(5)
    fracs = [0.01, 0.2, 0.4, 1.0]
    out = S.top_sums(df, ["g"], "s", "id", {"total": F.col("m")}, [(f, F.ceil(F.col("_size") * f)) for f in fracs]).collect()
    got = {(r["g"], r["_t"]): r["total"] for r in out}
    for g in ("hot", "cold"):
        some = [r[:3] for r in rows if r[3] == g]
        assert [got[g, t] for t in range(4)] == brute_top(some, [int(np.ceil(len(some) * f)) for f in fracs])
    assert S.top_sums(df.limit(0), [], "s", "id", {"total": F.col("m")}, [(0.2, F.col("_size"))]).count() == 0


def test_best_prefix_meets_brute_force(spark, limit):
    for seed in range(2):
        rng = np.random.default_rng(seed)
        rows = [(i, float(rng.integers(0, 12)) if seed % 2 else float(rng.random()), float(rng.integers(0, 900))) for i in range(300)]
        df = spark.createDataFrame(rows, "booking_id long, business_priority_score double, expected_loss double").repartition(3)
        order = sorted(rows, key=lambda r: (-r[1], r[0]))
        nets = np.cumsum([r[2] * 0.25 - 110 for r in order])
        got = R.prefix_optimum(df, 0.25, 110.0).first()
        k = int(np.argmax(nets)) + 1 if nets.max() > 0 else 0
        assert got["review_count"] == k
        assert got["net"] == pytest.approx(max(0.0, nets.max()), abs=1e-6)
    poor = df.withColumn("expected_loss", F.lit(1.0))
    assert R.prefix_optimum(poor).first()["review_count"] == 0.0 and R.prefix_optimum(df.limit(0)).first()["net"] == 0.0
