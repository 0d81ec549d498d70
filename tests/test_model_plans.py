from __future__ import annotations

import os
import re
import tempfile
import threading
import time
from contextlib import contextmanager

import pytest
from conftest import SMOKE
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stayguard.operators import encode as ENC
from stayguard.operators import models as M
from stayguard.plans import inputs


def test_columns_of_few_keys_are_looked_up_where_the_rows_are(spark, monkeypatch):
    rows = [(i, f"k{i % 7}", None if i % 5 == 0 else f"v{i % 3}", f"x{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    table = [("a", "k2", 9, 0.25), ("b", "v1", 50, 0.1), ("b", None, 40, 0.2), *[("c", f"x{i}", 1, i / 100) for i in range(0, 200, 2)]]
    stats = spark.createDataFrame(table, "column string, key string, n long, m double")
    want = {(c, k): (n, m) for c, k, n, m in table if k is not None}

    def check(out):
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            for c in "abc":
                f = r["_found"][c] if r["_found"] is not None else None
                assert (None if f is None else tuple(f)) == want.get((c, r[c]))

    out = ENC.lookup_columns(df, {c: F.col(c) for c in "abc"}, stats, ["n", "m"])
    assert not re.search(r"hashpartitioning|SortMergeJoin", out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString())
    check(out)
    monkeypatch.setattr(ENC, "HELD", 10)  # c now has too many keys to be broadcast whole
    check(ENC.lookup_columns(df, {c: F.col(c) for c in "abc"}, stats, ["n", "m"]))


def test_partitions_follow_cores_and_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(4 * cores)
    assert M.by_rows(many, 1000).rdd.getNumPartitions() == cores and M.by_rows(many, 1000).count() == 1000
    monkeypatch.setattr(M, "ROWS_A_TASK", 1)
    assert M.by_rows(many, 1000).rdd.getNumPartitions() == 4 * cores
    one = spark.range(1000).coalesce(1)
    assert M.spread(one, 1000).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "LEAST_ROWS_A_TASK", 10)
    assert M.spread(one, 1000).rdd.getNumPartitions() == min(cores, 100) and M.spread(one, 1000).count() == 1000


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data missing")
def test_training_derives_the_bookings_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(part):
        for b in part:
            reads.add(b.num_rows)
            yield b
    rows = inputs.prepared(spark, SMOKE)
    n = rows.count()
    model = M.train_model(rows.mapInArrow(counted, rows.schema), candidates=[("lr", "logreg", {"regParam": 1e-2, "maxIter": 5})])
    assert reads.value == n and model.metrics["rows_train"] + model.metrics["rows_calibration"] + model.metrics["rows_test"] == n


def forest_rows(spark, n=400):
    rows = [(i, 1 if i % 7 in (1, 2, 5) else 0, 1.0, Vectors.dense([float(i % 7), float(i % 5), float(i % 11)])) for i in range(n)]
    return spark.createDataFrame(rows, ["booking_id", "is_canceled", "weight", "features"])


def test_a_forest_keeps_its_node_ids_and_bounds_them(spark, monkeypatch):
    assert M.classifier("random_forest").getCacheNodeIds()
    rows, params = forest_rows(spark), {"numTrees": 7, "maxDepth": 3, "minInstancesPerNode": 2}
    whole = M.fit_classifier("random_forest", params, 42, 400, rows)
    assert [m.getNumTrees for m in whole] == [7]
    monkeypatch.setattr(M, "NODE_IDS", 400 * 3)
    parts = M.fit_classifier("random_forest", params, 42, 400, rows)
    assert [m.getNumTrees for m in parts] == [2, 2, 3] and all(m.getMaxDepth() == 3 for m in parts)
    out = {r["booking_id"]: r["raw_score"] for r in M.with_votes(parts, rows).collect()}
    trees = [m.transform(rows.drop("prediction")) for m in parts]
    alone = [{r["booking_id"]: r[m.getProbabilityCol()][1] for r in t.collect()} for m, t in zip(parts, trees)]
    assert len(out) == 400 and all(abs(out[i] - (2 * alone[0][i] + 2 * alone[1][i] + 3 * alone[2][i]) / 7) < 1e-12 for i in out)


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data missing")
def test_a_forest_in_parts_is_saved_and_scores_in_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "NODE_IDS", 1000)
    prepared = inputs.prepared(spark, SMOKE)
    model = M.train_model(prepared, candidates=[("rf", "random_forest", {"numTrees": 4, "maxDepth": 3})])
    assert sum(isinstance(s, RandomForestClassificationModel) for s in model.pipeline.stages) > 1
    assert model.metrics["candidate_metrics"][0]["rounds"] == 4
    path = tempfile.mkdtemp(prefix="stayguard-forest-", dir="/tmp")
    M.save_model(model, path)
    few = prepared.coalesce(1)
    scored = M.raw_probability(M.load_model(spark, path), few).select("booking_id", "raw_score")
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    a = dict(M.raw_probability(model, prepared).select("booking_id", "raw_score").collect())
    b = dict(scored.collect())
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data missing")
def test_the_derived_columns_are_computed_outside_whole_stage_code(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, "a"), (2, None, None)], "booking_id long, is_canceled int, x string")
    assert M.in_small_methods(rows, "is_canceled").collect() == rows.collect()
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its compiled stages only after it ran
    try:
        plain = spark.range(5).select("id", (F.col("id") + 1).alias("a"))
        shown = [df._jdf.queryExecution().executedPlan().toString().splitlines()[0] for df in (plain, M.in_small_methods(plain, "a"))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert shown[0].startswith("*(1) Project") and shown[1].startswith("Project")
    tops = []
    checkpoint = type(rows).checkpoint

    def seen(df, eager=True):
        tops.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df, eager)
    monkeypatch.setattr(type(rows), "checkpoint", seen)
    model = M.train_model(inputs.prepared(spark, SMOKE), candidates=[("lr", "logreg", {"regParam": 1e-2, "maxIter": 5})])
    wide = next(line for line in tops[0].splitlines() if "Project" in line)  # the first table that training writes: all derived columns
    assert "transform(array(is_canceled" in wide and "more fields" in wide
    scored = M.raw_probability(model, inputs.prepared(spark, SMOKE)).select("booking_id", "raw_score")
    assert any("transform(array(booking_id" in line for line in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Project" in line)


def test_fewer_fits_run_side_by_side_the_more_rows_they_hold(spark):
    lock, now, most = threading.Lock(), [0], [0]

    def fit(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        with lock:
            now[0] -= 1
        return x * x
    assert M.side_by_side(fit, [1, 2, 3, 4, 5], 10_000_000, 1_000_000, spark) == [1, 4, 9, 16, 25] and most == [1]
    assert M.side_by_side(fit, [1, 2, 3, 4, 5], 10, 1_000_000, spark) == [1, 4, 9, 16, 25] and 1 < most[0] <= M.FITS_AT_ONCE


def test_medians_come_from_counts_or_a_sketch_and_are_the_same(spark, monkeypatch):
    rows = [(i, None if i % 9 == 0 else i % 4, float("nan") if i % 10 == 0 else None if i % 13 == 0 else (i * 37 % 400) / 7.0, 1.5) for i in range(400)]
    train = spark.createDataFrame(rows, "booking_id long, a int, b double, c double")
    imputer = M.feature_stages(["a", "b", "c"], ["x"])[0]
    want = tuple(imputer.fit(train).surrogateDF.first())
    taken, sketch = [], type(train).approxQuantile
    monkeypatch.setattr(type(train), "approxQuantile", lambda df, columns, *more: taken.append(columns) or sketch(df, columns, *more))
    fitted = M.fit_imputer(imputer, train)
    assert tuple(fitted.surrogateDF.first()) == want and not taken  # few values: no sketch
    assert [r["b__imp"] for r in fitted.transform(train).collect()] == [r["b__imp"] for r in imputer.fit(train).transform(train).collect()]
    monkeypatch.setattr(M, "FEW_VALUES", -1)
    assert tuple(M.fit_imputer(imputer, train).surrogateDF.first()) == want and taken == [["a", "b", "c"]]
    with pytest.raises(Exception):
        M.fit_imputer(imputer, train.withColumn("a", F.lit(None).cast("int")))


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data missing")
def test_the_text_model_keeps_no_terms_and_leaves_no_tables(spark, monkeypatch):
    p = inputs.prepared(spark, SMOKE)
    rows = p.withColumn("booking_text", F.concat_ws(" ", "hotel", "meal", "market_segment"))
    checkpoints, checkpoint = [], type(rows).checkpoint
    monkeypatch.setattr(type(rows), "checkpoint", lambda df, eager=True: checkpoints.append(df.columns) or checkpoint(df, eager))
    kept, keeping = [], M.files.kept_tables

    @contextmanager
    def watched(spark):
        with keeping(spark) as keep:
            yield lambda df: kept.append(dict(df.dtypes)) or keep(df)
    monkeypatch.setattr(M.files, "kept_tables", watched)
    (_, _, vec, _), report = M.text_model(rows, reg_params=(1e-3, 1e-2))
    assert len(report) == 2 and all(0.0 <= r["valid_roc_auc"] <= 1.0 for r in report)
    assert len(kept) == 4 and not any(t.startswith("array") for columns in kept for t in columns.values())
    assert not any("booking_text" in columns or "features" in columns or "_terms" in columns for columns in checkpoints)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert os.path.isdir(folder) and not [x for x in os.listdir(folder) if x.startswith("kept-")]
