from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayguard.operators import evaluate as EV
from stayguard.operators.ordered import global_order
from stayguard.operators.select import exact_quantiles


def scores(spark, y, s, groups=None):
    g = groups or ["a"] * len(y)
    data = [(i, int(a), float(b), c) for i, (a, b, c) in enumerate(zip(y, s, g), start=1)]
    return spark.createDataFrame(data, "booking_id long, y int, s double, g string")


def brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_topk_by_hand(spark):
    df = scores(spark, [1, 0, 1, 0, 1], [0.9, 0.8, 0.7, 0.1, 0.2])
    r = EV.topk(df, "y", "s", "booking_id", 0.4, "floor").first()
    assert r["precision_at_40"] == pytest.approx(0.5)
    assert r["recall_at_40"] == pytest.approx(1 / 3)
    assert r["lift_at_40"] == pytest.approx(0.5 / 0.6)


def test_auc_and_ap_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 600).tolist()
    s = (np.round(rng.random(600) * 20) / 20).tolist()  # heavy ties
    df = scores(spark, y, s)
    assert EV.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert EV.average_precision(df, "y", "s").first()["pr_auc"] == pytest.approx(brute_ap(y, s), abs=1e-12)


def test_grouped_auc(spark):
    y = [1, 0, 1, 0, 1, 1, 0, 0]
    s = [0.9, 0.1, 0.8, 0.2, 0.3, 0.4, 0.5, 0.6]
    g = ["a"] * 4 + ["b"] * 4
    out = {r["g"]: r["roc_auc"] for r in EV.roc_auc(scores(spark, y, s, g), "y", "s", ["g"]).collect()}
    assert out["a"] == 1.0 and out["b"] == 0.0


def test_global_order_ranks_and_running_sums(spark):
    n = 5000
    df = spark.range(1, n + 1).withColumn("v", (F.col("id") % 7).cast("double")).withColumn("g", F.col("id") % 3)
    out = global_order(df, [F.desc("v"), F.asc("id")], "rk", cumulative={"cv": F.col("v")}, num_partitions=7)
    pdf = out.toPandas().sort_values("rk")
    ref = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert pdf["rk"].tolist() == list(range(1, n + 1))
    assert pdf["id"].tolist() == ref["id"].tolist()
    assert np.allclose(pdf["cv"].to_numpy(), ref["v"].cumsum().to_numpy())
    grp = global_order(df, [F.asc("id")], "rk", partition_by=["g"], num_partitions=5).toPandas()
    for _, part in grp.groupby("g"):
        assert sorted(part["rk"]) == list(range(1, len(part) + 1))


def test_global_order_splits_a_hot_value(spark):
    """A third of the rows share one score: the slices stay balanced and ranks stay exact."""
    n = 9000
    df = spark.range(1, n + 1).withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.rand(5)))
    out = global_order(df, [F.desc("v"), F.asc("id")], "rk", num_partitions=6)
    sizes = [r["c"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
    pdf = out.toPandas().sort_values("rk")
    assert pdf["rk"].tolist() == list(range(1, n + 1))
    ref = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert pdf["id"].tolist() == ref["id"].tolist()
    assert max(sizes) < n / 2  # the 3,000 tied rows do not land in one task


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1001)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "booking_id long, x double")
    probs = [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]
    got = {r["prob"]: r["q"] for r in exact_quantiles(df, "x", probs, "booking_id").collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(x, p)), abs=1e-12)


def test_f2_threshold_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 2)
    grid = np.quantile(s, np.linspace(0.05, 0.95, 61))
    best_t, best = 0.5, -1
    for t in grid:
        pred = s >= t
        tp = int(((y == 1) & pred).sum()); fp = int(((y == 0) & pred).sum()); fn = int(((y == 1) & ~pred).sum())
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        f2 = 5 * p * r / (4 * p + r) if p + r else 0.0
        if f2 > best:
            best_t, best = float(t), f2
    r = EV.f2_threshold(scores(spark, y.tolist(), s.tolist()), "y", "s", "booking_id").first()
    assert r["threshold"] == pytest.approx(best_t, abs=1e-12) and r["f2"] == pytest.approx(best, abs=1e-12)


def test_confusion_zero_division(spark):
    r = EV.confusion(scores(spark, [0, 0], [0.1, 0.2]), "y", "s", 0.5).first()
    assert r["tp"] == 0 and r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0


def test_empty_tables_give_zero_shares(spark):
    from stayguard.operators import analyze as A
    df = spark.createDataFrame([], "a int, b string")
    assert [r["missing_share"] for r in A.missing_report(df).collect()] == [0.0, 0.0]
    assert [(r["n_unique"], r["missing_rate"]) for r in A.column_profile(df).collect()] == [(0, 0.0)] * 2


def test_null_groups_and_null_columns_are_kept(spark):
    from pyspark.sql import functions as F
    from stayguard.operators import analyze as A
    from stayguard.operators import evaluate as E
    rows = [(i, "a" if i % 2 else None, i % 3 == 0, i / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "booking_id long, g string, y boolean, s double").withColumn("y", F.col("y").cast("int"))
    assert E.roc_auc(df, "y", "s", ["g"]).count() == E.average_precision(df, "y", "s", ["g"]).count() == 2
    assert E.topk(df, "y", "s", "booking_id", 0.2, "ceil", ["g"]).count() == 2
    prof = {r["column"]: r for r in A.describe(df.withColumn("void", F.lit(None).cast("double")), ["s", "void"], "booking_id").collect()}
    assert prof["void"]["count"] == 0 and prof["void"]["p50"] is None and prof["s"]["count"] == 20
    counts = A.domain_complete_counts(df, "g", F.when(F.col("s") > 1, "hi").otherwise("lo"), ["lo", "hi"])
    assert sum(r["count"] for r in counts.collect()) == 20
    exact = {r["column"]: r["n_unique"] for r in A.column_profile(df).collect()}
    assert {r["column"]: r["n_unique"] for r in A.column_profile(df, approx=True).collect()} == exact
