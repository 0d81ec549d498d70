"""Business layer: score -> probability -> money at risk -> action.

All narrow projections and global one-row aggregates; nothing here sorts the
whole table. Readers that want the ranked list call ``rank.priority_order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.constants import MIN_ACTION_EXPECTED_LOSS, PREDICTION_COLUMNS
from ..functions.rules import (
    actionable, deposit_loss_factor, expected_loss, financial_priority, is_high, recommended_action,
    risk_category, rule_score, tariff_protected_loss, top_factors,
)


def score_with_rules(prepared: DataFrame, out_col: str = "raw_score") -> DataFrame:
    """M1 on prepared bookings."""
    return prepared.withColumn(out_col, rule_score())


def enrich_predictions(prepared: DataFrame, raw_score: Column | str = "raw_score",
                       calibrated: Column | str | None = None,
                       deposit_factors: dict[str, float] | None = None) -> DataFrame:
    """Add the business fields. ``calibrated`` falls back to the raw score."""
    raw = F.col(raw_score) if isinstance(raw_score, str) else raw_score
    cal = raw if calibrated is None else (F.col(calibrated) if isinstance(calibrated, str) else calibrated)
    out = prepared.withColumns({
        "risk_score": clip(raw.cast("double"), 0.0, 1.0),
        "cancellation_probability": clip(cal.cast("double"), 0.0, 1.0),
    })
    p = F.col("cancellation_probability")
    out = out.withColumns({
        "risk_category": risk_category(p),
        "deposit_loss_factor": deposit_loss_factor(F.col("deposit_type"), deposit_factors),
    })
    out = out.withColumn("expected_loss", expected_loss(p, F.col("booking_value").cast("double"),
                                                         F.col("deposit_loss_factor")))
    cat, loss = F.col("risk_category"), F.col("expected_loss")
    out = out.withColumns({
        "business_priority_score": loss,
        "actionable": actionable(cat, loss),
        "recommended_action": recommended_action(cat, loss),
        "top_factors": top_factors(p),
    })
    return out.withColumn("financial_priority", financial_priority(F.col("actionable")))


def predictions(prepared: DataFrame, **kw) -> DataFrame:
    """M21 with the rule model: prepared bookings -> the 20-column prediction table."""
    keep = [c for c in kw.pop("keep", ())]
    scored = enrich_predictions(score_with_rules(prepared), **kw)
    return scored.select(*PREDICTION_COLUMNS, *[c for c in keep if c not in PREDICTION_COLUMNS])


def batch_summary(pred: DataFrame) -> DataFrame:
    """A3 + A4: one aggregate by category, rolled up; zeros (not NULL) for an empty input; category map."""
    p = F.coalesce(F.col("cancellation_probability"), F.col("risk_score"))
    act = F.coalesce(F.col("actionable"), is_high(F.col("risk_category"))
                     & (F.col("expected_loss") >= MIN_ACTION_EXPECTED_LOSS))
    # one pass: a row per category, rolled up into one
    by = pred.groupBy("risk_category").agg(
        F.count(F.lit(1)).alias("n"), F.count(p).alias("_np"), F.sum(p).alias("_sp"), F.count_if(act).alias("_act"),
        F.sum("expected_loss").alias("_loss"), F.sum(F.when(act, F.col("expected_loss"))).alias("_act_loss"),
        F.sum("booking_value").alias("_value"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.try_divide(F.sum("_sp"), F.sum("_np")), F.lit(0.0)).alias("avg_risk_score"),
        F.coalesce(F.sum(F.when(is_high(F.col("risk_category")), F.col("n"))), F.lit(0)).alias("high_or_critical"),
        F.coalesce(F.sum("_act"), F.lit(0)).alias("actionable_count"),
        zero("_loss").alias("expected_loss_total"), zero("_act_loss").alias("actionable_expected_loss_total"),
        zero("_value").alias("booking_value_total"),
        F.map_from_entries(F.collect_list(F.when(F.col("risk_category").isNotNull(), F.struct("risk_category", "n")))).alias("category_counts"))


def batch_header(pred: DataFrame) -> DataFrame:
    """KPI header stored with a batch: loss total counts High/Critical only."""
    high = is_high(F.col("risk_category"))
    return pred.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(high).alias("high_risk_count"),
        F.coalesce(F.sum("booking_value"), F.lit(0.0)).alias("total_booking_value"),
        F.coalesce(F.sum(F.when(high, F.col("expected_loss"))), F.lit(0.0)).alias("total_expected_loss"),
    )


def kpi_strip(pred: DataFrame, success_rate: float = 0.25, cost_per_action: float = 150.0) -> DataFrame:
    """A7 + B8: one global conditional aggregate over the scored table."""
    p = F.coalesce(F.col("cancellation_probability"), F.col("risk_score"))
    act = F.col("actionable")
    base = pred.agg(
        F.coalesce(F.sum("booking_value"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("expected_loss"), F.lit(0.0)).alias("expected_loss_all"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("avg_risk"),
        F.coalesce(F.sum(tariff_protected_loss(p, F.col("booking_value"), F.col("deposit_loss_factor"))),
                   F.lit(0.0)).alias("tariff_protected"),
        F.count_if(act).alias("review_count"),
        F.coalesce(F.sum(F.when(act, F.col("expected_loss"))), F.lit(0.0)).alias("review_expected_loss"),
    )
    return base.withColumns({
        "protected": F.col("review_expected_loss") * F.lit(float(success_rate)),
        "cost": F.col("review_count") * F.lit(float(cost_per_action)),
    }).withColumns({
        "net": F.col("protected") - F.col("cost"),
        "loss_concentration": F.when(F.col("expected_loss_all") > 0,
                                     F.col("review_expected_loss") / F.col("expected_loss_all")).otherwise(F.lit(0.0)),
    })
