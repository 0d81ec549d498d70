from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stayguard.functions.constants import ACTION_MANUAL_REVIEW
from stayguard.functions.rules import deposit_loss_factor, risk_category
from stayguard.operators import business as B
from stayguard.operators import rank as R
from stayguard.operators.features import prepare_features


def enrich(prepared, scores: dict, calibrated: dict | None = None):
    m = F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), F.lit(float(v)))])
    df = prepared.withColumn("raw", F.element_at(m, F.col("booking_id")))
    if calibrated:
        c = F.create_map(*[x for k, v in calibrated.items() for x in (F.lit(k), F.lit(float(v)))])
        df = df.withColumn("cal", F.element_at(c, F.col("booking_id")))
        return B.enrich_predictions(df, "raw", "cal")
    return B.enrich_predictions(df, "raw")


@pytest.mark.parametrize("p,cat", [(1.0, "Critical"), (0.8, "Critical"), (0.79, "High"), (0.6, "High"),
                                   (0.59, "Medium"), (0.3, "Medium"), (0.29, "Low"), (0.0, "Low")])
def test_risk_thresholds(spark, p, cat):
    assert spark.range(1).select(risk_category(F.lit(p)).alias("c")).first()["c"] == cat


@pytest.mark.parametrize("dep,factor", [("No Deposit", 1.0), ("Refundable", 1.0), ("Non Refund", 0.0),
                                        ("Something", 1.0), (None, 1.0)])
def test_deposit_factors(spark, dep, factor):
    v = spark.range(1).select(deposit_loss_factor(F.lit(dep).cast("string")).alias("f")).first()["f"]
    assert v == factor


def test_enrich_categories_actions_and_loss(two_bookings):
    out = {r["booking_id"]: r for r in enrich(prepare_features(two_bookings), {"B-1": 0.85, "B-2": 0.20}).collect()}
    assert out["B-1"]["risk_category"] == "Critical"
    assert out["B-1"]["recommended_action"] == ACTION_MANUAL_REVIEW
    assert out["B-1"]["expected_loss"] == pytest.approx(0.85 * 360.0)
    assert out["B-2"]["risk_category"] == "Low" and out["B-2"]["deposit_loss_factor"] == 0.0


def test_expected_loss_uses_calibrated_probability(two_bookings):
    out = {r["booking_id"]: r for r in enrich(prepare_features(two_bookings), {"B-1": 0.9, "B-2": 0.9},
                                              {"B-1": 0.5, "B-2": 0.5}).collect()}
    assert out["B-1"]["risk_score"] == 0.9 and out["B-1"]["cancellation_probability"] == 0.5
    assert out["B-1"]["expected_loss"] == pytest.approx(0.5 * 360.0)


def test_non_refund_is_never_actionable(two_bookings):
    out = {r["booking_id"]: r for r in enrich(prepare_features(two_bookings), {"B-1": 0.99, "B-2": 0.99}).collect()}
    assert out["B-1"]["actionable"] is True
    assert out["B-2"]["actionable"] is False and out["B-2"]["expected_loss"] == 0.0


def test_priority_order_not_input_order(two_bookings):
    df = enrich(prepare_features(two_bookings), {"B-1": 0.90, "B-2": 0.95})
    top = R.top_n(df, 2, R.priority_order(df)).collect()
    assert top[0]["booking_id"] == "B-1"


def test_top_factors_at_most_five(one_booking):
    r = enrich(prepare_features(one_booking), {"B-1": 0.9}).first()
    assert 1 <= len(r["top_factors"]) <= 5
    assert any("глубина" in x for x in r["top_factors"]) and any("депозит" in x for x in r["top_factors"])


def test_empty_input_summary_is_zero(spark, one_booking):
    empty = enrich(prepare_features(one_booking), {"B-1": 0.9}).where("false")
    s = B.batch_summary(empty).first()
    assert s["rows"] == 0 and s["expected_loss_total"] == 0.0 and s["booking_value_total"] == 0.0
    e = R.economics(empty, shares=(0.2,)).first()
    assert e["selected_bookings"] == 0.0 and e["net_effect"] == 0.0


def test_economics_arithmetic(two_bookings):
    df = enrich(prepare_features(two_bookings), {"B-1": 0.85, "B-2": 0.20})
    sim = R.economics(df, shares=(0.5,), success_rate=0.25, cost_per_action=10).first()
    assert sim["selected_bookings"] == 1.0
    assert sim["expected_loss"] == pytest.approx(0.85 * 360.0)
    assert sim["gross_protected_revenue"] == pytest.approx(sim["expected_loss"] * 0.25)
    assert sim["intervention_cost"] == 10.0
    assert sim["net_effect"] == pytest.approx(sim["gross_protected_revenue"] - 10.0)


def test_prefix_optimum_by_hand(spark):
    rows = [(i, float(v), float(v)) for i, v in enumerate([1000, 800, 500, 100, 50], start=1)]
    df = spark.createDataFrame(rows, "booking_id long, business_priority_score double, expected_loss double")
    r = R.prefix_optimum(df, success_rate=0.25, cost_per_action=150).first()
    # nets: 100, 150, 125, 0, -137.5 -> best prefix of 2
    assert r["review_count"] == 2.0 and r["net"] == pytest.approx(150.0)
    none = R.prefix_optimum(df, success_rate=0.01, cost_per_action=150).first()
    assert none["review_count"] == 0.0 and none["net"] == 0.0
