"""Business rules and the rule score as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clip
from .constants import (
    ACTION_CONFIRMATION, ACTION_DEPOSIT_REVIEW, ACTION_LOW_FINANCIAL_PRIORITY, ACTION_MANUAL_REVIEW,
    ACTION_NO_ACTION, DEPOSIT_LOSS_FACTOR, FACTOR_GENERIC, FACTOR_LONG_LEAD, FACTOR_NO_DEPOSIT,
    FACTOR_NO_PARKING, FACTOR_NO_REQUESTS, FACTOR_NOT_REPEATED, FACTOR_PREV_CANCEL, FACTOR_RISKY_SEGMENT_PREFIX,
    FACTOR_TATO, FACTOR_VERY_LONG_LEAD, FINANCIAL_PRIORITY_NONE, FINANCIAL_PRIORITY_REVIEW,
    MIN_ACTION_EXPECTED_LOSS, RISK_CRITICAL, RISK_HIGH, RISK_MEDIUM, RISKY_SEGMENTS, RULE_BASE, RULE_LEAD_90,
    RULE_LEAD_180, RULE_MAX, RULE_MIN, RULE_NO_DEPOSIT, RULE_NO_REQUESTS, RULE_PARKING, RULE_PREV_CANCEL,
    RULE_REPEATED, RULE_SEGMENT, RULE_TATO,
)


def _n(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def _term(cond: Column, weight: float) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))


def rule_score() -> Column:
    """M1: deterministic score, terms added in a fixed order, clipped to [0.02, 0.98]."""
    lead = _n("lead_time")
    s = F.lit(RULE_BASE)
    s = s + _term(lead > 90, RULE_LEAD_90)
    s = s + _term(lead > 180, RULE_LEAD_180)
    s = s + _term(F.col("deposit_type") == "No Deposit", RULE_NO_DEPOSIT)
    s = s + _term(F.col("market_segment").isin(*RISKY_SEGMENTS), RULE_SEGMENT)
    s = s + _term(F.col("distribution_channel") == "TA/TO", RULE_TATO)
    s = s + _term(_n("previous_cancellations") > 0, RULE_PREV_CANCEL)
    s = s + _term(_n("total_of_special_requests") == 0, RULE_NO_REQUESTS)
    s = s + _term(_n("required_car_parking_spaces") > 0, RULE_PARKING)
    s = s + _term(_n("is_repeated_guest") == 1, RULE_REPEATED)
    return clip(s, RULE_MIN, RULE_MAX)


def risk_category(p: Column) -> Column:
    """B1"""
    return (F.when(p >= RISK_CRITICAL, "Critical").when(p >= RISK_HIGH, "High")
            .when(p >= RISK_MEDIUM, "Medium").otherwise("Low"))


def deposit_loss_factor(deposit_type: Column, factors: dict[str, float] | None = None) -> Column:
    """B2: known tariffs from the table, anything else (and NULL) -> 1.0."""
    factors = factors or DEPOSIT_LOSS_FACTOR
    pairs = []
    for k, v in factors.items():
        pairs += [F.lit(k), F.lit(float(v))]
    key = F.coalesce(deposit_type.cast("string"), F.lit("No Deposit"))
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(1.0))


def expected_loss(p: Column, booking_value: Column, factor: Column) -> Column:
    """B3"""
    return p * F.greatest(booking_value, F.lit(0.0)) * factor


def is_high(category: Column) -> Column:
    return category.isin("High", "Critical")


def actionable(category: Column, loss: Column) -> Column:
    """P21"""
    return is_high(category) & (loss >= MIN_ACTION_EXPECTED_LOSS)


def financial_priority(act: Column) -> Column:
    """B4"""
    return F.when(act, FINANCIAL_PRIORITY_REVIEW).otherwise(FINANCIAL_PRIORITY_NONE)


def recommended_action(category: Column, loss: Column) -> Column:
    """A low expected loss overrides only High / Critical."""
    return (F.when(is_high(category) & (loss < MIN_ACTION_EXPECTED_LOSS), ACTION_LOW_FINANCIAL_PRIORITY)
            .when(category == "Critical", ACTION_MANUAL_REVIEW)
            .when(category == "High", ACTION_DEPOSIT_REVIEW)
            .when(category == "Medium", ACTION_CONFIRMATION)
            .otherwise(ACTION_NO_ACTION))


def top_factors(p: Column) -> Column:
    """Up to five reasons in a fixed order; a generic one when p >= .8 and none applies."""
    lead = _n("lead_time")
    seg = F.col("market_segment").cast("string")
    reasons = F.array(
        F.when(lead > 180, F.lit(FACTOR_VERY_LONG_LEAD)).when(lead > 90, F.lit(FACTOR_LONG_LEAD)),
        F.when(F.col("deposit_type") == "No Deposit", F.lit(FACTOR_NO_DEPOSIT)),
        F.when(_n("previous_cancellations") > 0, F.lit(FACTOR_PREV_CANCEL)),
        F.when(_n("total_of_special_requests") == 0, F.lit(FACTOR_NO_REQUESTS)),
        F.when(seg.isin(*RISKY_SEGMENTS), F.concat(F.lit(FACTOR_RISKY_SEGMENT_PREFIX), seg)),
        F.when(F.col("distribution_channel") == "TA/TO", F.lit(FACTOR_TATO)),
        F.when(_n("required_car_parking_spaces") == 0, F.lit(FACTOR_NO_PARKING)),
        F.when(_n("is_repeated_guest") == 0, F.lit(FACTOR_NOT_REPEATED)),
    )
    found = F.array_compact(reasons)
    return F.when((F.size(found) == 0) & (p >= 0.8), F.array(F.lit(FACTOR_GENERIC))).otherwise(F.slice(found, 1, 5))


def tariff_protected_loss(p: Column, booking_value: Column, factor: Column) -> Column:
    """The part of the value a non-refundable tariff already protects."""
    return (clip(F.coalesce(p, F.lit(0.0)), 0.0, 1.0) * F.greatest(F.coalesce(booking_value, F.lit(0.0)), F.lit(0.0))
            * (F.lit(1.0) - clip(F.coalesce(factor, F.lit(1.0)), 0.0, 1.0)))


def error_type(y: Column, pred: Column) -> Column:
    """B9"""
    return (F.when((y == 1) & (pred == 1), "TP").when((y == 0) & (pred == 0), "TN")
            .when((y == 0) & (pred == 1), "FP").otherwise("FN"))


# --- older notebook rule set (B7, M2) ------------------------------------------

def notebook_rule_score() -> Column:
    """M2 (before normalisation): weighted sum of six indicators."""
    from .constants import (
        NB_RULE_LEAD_90, NB_RULE_NO_DEPOSIT, NB_RULE_NO_PARKING, NB_RULE_NO_REQUESTS, NB_RULE_PREV_CANCEL,
        NB_RULE_SEGMENT, NB_RULE_SEGMENTS,
    )
    s = F.lit(0.0)
    s = s + _term(_n("lead_time") > 90, NB_RULE_LEAD_90)
    s = s + _term(F.col("deposit_type") == "No Deposit", NB_RULE_NO_DEPOSIT)
    s = s + _term(_n("previous_cancellations") > 0, NB_RULE_PREV_CANCEL)
    s = s + _term(_n("total_of_special_requests") == 0, NB_RULE_NO_REQUESTS)
    s = s + _term(_n("required_car_parking_spaces") == 0, NB_RULE_NO_PARKING)
    s = s + _term(F.col("market_segment").isin(*NB_RULE_SEGMENTS), NB_RULE_SEGMENT)
    return s


def notebook_action(category: Column, deposit_type: Column) -> Column:
    """Action by deposit type first, then by category."""
    from .constants import (
        NB_ACTION_MEDIUM, NB_ACTION_NO_DEPOSIT, NB_ACTION_NON_REFUND, NB_ACTION_NONE, NB_ACTION_REFUNDABLE,
    )
    return (F.when(deposit_type == "Non Refund", NB_ACTION_NON_REFUND)
            .when(is_high(category) & (deposit_type == "No Deposit"), NB_ACTION_NO_DEPOSIT)
            .when(is_high(category) & (deposit_type == "Refundable"), NB_ACTION_REFUNDABLE)
            .when(category == "Medium", NB_ACTION_MEDIUM)
            .otherwise(NB_ACTION_NONE))


def notebook_why_risky() -> Column:
    """The first matching reason."""
    from .constants import NB_WHY_DEFAULT, NB_WHY_LONG_LEAD, NB_WHY_NO_REQUESTS, NB_WHY_PREV_CANCEL
    return (F.when((_n("total_of_special_requests") == 0) & (_n("required_car_parking_spaces") == 0), NB_WHY_NO_REQUESTS)
            .when(_n("lead_time") > 90, NB_WHY_LONG_LEAD)
            .when(_n("previous_cancellations") > 0, NB_WHY_PREV_CANCEL)
            .otherwise(NB_WHY_DEFAULT))
