from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from stayguard.operators import models as M
from stayguard.plans import inputs

pytestmark = pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data missing")


@pytest.fixture(scope="module")
def prepared(spark):
    return inputs.prepared(spark, SMOKE)


def test_train_predict_save_load(spark, prepared):
    model = M.train_model(prepared, candidates=[("lr", "logreg", {"regParam": 1e-2, "maxIter": 20})])
    m = model.metrics
    assert 0.0 <= m["roc_auc"] <= 1.0 and 0.0 <= m["brier"] <= 1.0
    assert len(m["candidate_metrics"]) == 1
    pred = M.predict(model, prepared)
    assert pred.count() == prepared.count()
    bad = pred.where((F.col("cancellation_probability") < 0) | (F.col("cancellation_probability") > 1)).count()
    assert bad == 0
    path = tempfile.mkdtemp(prefix="stayguard-model-", dir="/tmp")
    M.save_model(model, path)
    again = M.load_model(spark, path)
    a = {r["booking_id"]: r["risk_score"] for r in pred.select("booking_id", "risk_score").collect()}
    b = {r["booking_id"]: r["risk_score"] for r in M.predict(again, prepared).select("booking_id", "risk_score").collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_a_row_bound_holds_for_the_classifier_fit_only(spark, prepared, monkeypatch):
    lr = [("lr", "logreg", {"regParam": 1e-2, "maxIter": 5})]
    model = M.train_model(prepared, candidates=lr, max_rows=300)
    sizes = {r["split"]: r["count"] for r in prepared.groupBy("split").count().collect()}
    m = model.metrics
    assert sizes["train"] > 400 and 200 < m["rows_fit"] < 400
    assert (m["rows_train"], m["rows_calibration"], m["rows_test"]) == (sizes["train"], sizes["valid"], sizes["test"])
    assert model.encoder.stats.where("column = 'agent'").agg(F.sum("n")).first()[0] == sizes["train"]
    from stayguard.plans import model_queries
    asked = []
    monkeypatch.setattr(inputs, "memo", lambda spark, sf, kind, build: build())
    monkeypatch.setattr(M, "train_model", lambda rows, **options: asked.append(options) or model)
    model_queries._trained(spark, SMOKE)
    model_queries.q_forest_scores(spark, SMOKE)
    assert len(asked) == 2 and not any(options.get("max_rows") for options in asked)


def test_the_balanced_logistic_regression_is_a_query(spark, prepared):
    from stayguard.plans import catalog
    catalog._load_all()
    row = catalog.QUERIES["logreg_metrics"](spark, SMOKE).first()
    assert row["model"].startswith("Balanced logistic regression") and row["rows_fit"] == prepared.where("split = 'train'").count()
    assert 0.0 <= row["roc_auc"] <= 1.0 and 0.0 <= row["brier"] <= 1.0


def test_a_broken_model_is_an_error_and_file_addresses_are_found(spark, prepared):
    path = tempfile.mkdtemp(prefix="stayguard-model-")
    os.makedirs(f"{path}/meta")
    assert M.model_exists(spark, f"file:{path}") and not M.model_exists(spark, f"file:{path}-none")
    with pytest.raises(Exception):
        M.score_bookings(spark, prepared, model_path=path)


def test_missing_model_falls_back_to_rules(spark, prepared):
    out = M.score_bookings(spark, prepared, model_path="/tmp/stayguard-no-such-model")
    assert "risk_category" in out.columns and out.count() == prepared.count()
    with pytest.raises(FileNotFoundError):
        M.score_bookings(spark, prepared, model_path="/tmp/stayguard-no-such-model", require_trained=True)


def test_platt_calibration_is_monotone(spark):
    rows = [(i, float(s), y) for i, (s, y) in enumerate([(0.05, 0), (0.15, 0), (0.35, 0), (0.70, 1), (0.90, 1)])]
    df = spark.createDataFrame(rows, "booking_id long, raw_score double, is_canceled int")
    cal = M.fit_platt(df)
    out = M.apply_calibration(df, cal).orderBy("raw_score").collect()
    probs = [r["calibrated"] for r in out]
    assert probs == sorted(probs) and all(0 <= p <= 1 for p in probs)
    one_class = df.where("is_canceled = 0")
    assert M.fit_platt(one_class) is None
