"""Query catalogue: one Spark query per operator of the survey's inventory, plus the
independent DuckDB SQL that checks it. Each query reads the given tables in full.

Conventions for a clean comparison: doubles are rounded to 6 places, counts are
BIGINT, arrays are joined to text, every computed column is aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs
from ..functions.columns import round_binary
from .oracle_base import BASE, with_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, base: bool = True):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_texts((BASE + sql) if base else sql)
        return fn
    return deco


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = round_binary(col.cast("double"), 6)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def i32(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("int").alias(name or c)


# ---------------------------------------------------------------------------
# sources and features
# ---------------------------------------------------------------------------

@register("booking_view", "SELECT * FROM bookings")
def q_booking_view(spark, sf):
    return inputs.raw(spark, sf)


FLAG_FEATURES = [
    "has_children", "has_previous_cancellations", "has_special_requests", "is_long_lead_booking", "is_weekend_stay",
    "is_single_adult", "is_family", "has_parking_request", "no_special_no_parking", "country_missing",
    "agent_missing", "has_company",
]
DOUBLE_FEATURES = [
    "total_nights", "total_guests", "booking_value", "month_sin", "month_cos", "week_sin", "week_cos",
    "weekend_share", "adr_per_guest", "lead_time_x_value", "lead_time_x_requests", "lead_time_log", "adr_log",
    "value_per_night_log",
]


@register("features_numeric", """
SELECT booking_id,
  CAST(CASE WHEN children + babies > 0 THEN 1 ELSE 0 END AS INT) AS has_children,
  CAST(CASE WHEN previous_cancellations > 0 THEN 1 ELSE 0 END AS INT) AS has_previous_cancellations,
  CAST(CASE WHEN total_of_special_requests > 0 THEN 1 ELSE 0 END AS INT) AS has_special_requests,
  CAST(CASE WHEN lead_time > 90 THEN 1 ELSE 0 END AS INT) AS is_long_lead_booking,
  CAST(CASE WHEN stays_in_weekend_nights > 0 THEN 1 ELSE 0 END AS INT) AS is_weekend_stay,
  CAST(CASE WHEN adults = 1 AND children = 0 AND babies = 0 THEN 1 ELSE 0 END AS INT) AS is_single_adult,
  CAST(CASE WHEN adults >= 1 AND children + babies > 0 THEN 1 ELSE 0 END AS INT) AS is_family,
  CAST(CASE WHEN required_car_parking_spaces > 0 THEN 1 ELSE 0 END AS INT) AS has_parking_request,
  CAST(CASE WHEN total_of_special_requests = 0 AND required_car_parking_spaces = 0 THEN 1 ELSE 0 END AS INT) AS no_special_no_parking,
  CAST(country_missing AS INT) AS country_missing, CAST(agent_missing AS INT) AS agent_missing,
  CAST(has_company AS INT) AS has_company,
  ROUND(total_nights, 6) AS total_nights, ROUND(total_guests, 6) AS total_guests,
  ROUND(booking_value, 6) AS booking_value,
  ROUND(sin(2 * pi() * arrival_month_num / 12), 6) + 0.0 AS month_sin,
  ROUND(cos(2 * pi() * arrival_month_num / 12), 6) + 0.0 AS month_cos,
  ROUND(sin(2 * pi() * arrival_date_week_number / 53), 6) + 0.0 AS week_sin,
  ROUND(cos(2 * pi() * arrival_date_week_number / 53), 6) + 0.0 AS week_cos,
  ROUND(stays_in_weekend_nights / GREATEST(total_nights, 1), 6) AS weekend_share,
  ROUND(adr / GREATEST(total_guests, 1), 6) AS adr_per_guest,
  ROUND(lead_time * ln(1 + GREATEST(booking_value, 0)), 6) AS lead_time_x_value,
  ROUND(lead_time * (1 + total_of_special_requests), 6) AS lead_time_x_requests,
  ROUND(ln(1 + lead_time), 6) AS lead_time_log,
  ROUND(ln(1 + adr), 6) AS adr_log,
  ROUND(ln(1 + GREATEST(booking_value / GREATEST(total_nights, 1), 0)), 6) AS value_per_night_log
FROM prepared
""")
def q_features_numeric(spark, sf):
    p = inputs.prepared(spark, sf)
    return p.select("booking_id", *[i32(c) for c in FLAG_FEATURES], *[r6(c) for c in DOUBLE_FEATURES])


@register("dates", """
SELECT booking_id, arrival_date, booking_creation_date,
  CAST(arrival_date - CAST(lead_time AS INT) AS DATE) AS creation_from_lead,
  CAST(arrival_date_year AS INT) AS arrival_date_year, arrival_date_month,
  CAST(arrival_month_num AS INT) AS arrival_month_num,
  CAST(arrival_date_week_number AS INT) AS arrival_date_week_number,
  CAST(arrival_date_day_of_month AS INT) AS arrival_date_day_of_month,
  arrival_dayofweek,
  CAST(CASE WHEN arrival_dayofweek IN (5, 6) THEN 1 ELSE 0 END AS INT) AS arrival_is_weekend,
  arrival_quarter, arrival_season,
  strftime(arrival_date, '%Y-%m') AS arrival_ym,
  make_date(CAST(arrival_date_year AS BIGINT), CAST(arrival_month_num AS BIGINT),
            LEAST(CAST(arrival_date_day_of_month AS BIGINT), 28)) AS arrival_from_parts_clipped,
  split
FROM prepared
""")
def q_dates(spark, sf):
    from ..functions.columns import date_from_parts, year_month
    from ..sources.bookings import split_label
    p = inputs.prepared(spark, sf)
    return p.select(
        "booking_id", "arrival_date", "booking_creation_date",
        F.date_sub("arrival_date", F.col("lead_time").cast("int")).alias("creation_from_lead"),
        i32("arrival_date_year"), "arrival_date_month", i32("arrival_month_num"), i32("arrival_date_week_number"),
        i32("arrival_date_day_of_month"), i32("arrival_dayofweek"), i32("arrival_is_weekend"),
        i32("arrival_quarter"), "arrival_season",
        year_month(F.col("arrival_date")).alias("arrival_ym"),
        date_from_parts(F.col("arrival_date_year"), F.col("arrival_month_num"),
                        F.least(F.col("arrival_date_day_of_month"), F.lit(28.0))).alias("arrival_from_parts_clipped"),
        split_label(F.col("booking_creation_date")).alias("split"),
    )


# ---------------------------------------------------------------------------
# scoring and business rules
# ---------------------------------------------------------------------------

@register("rule_score", "SELECT booking_id, ROUND(risk_score, 6) AS risk_score FROM scored")
def q_rule_score(spark, sf):
    return inputs.scored(spark, sf).select("booking_id", r6("risk_score"))


FACTORS_SQL = """
, factors AS (
  SELECT booking_id, list_filter([
      CASE WHEN lead_time > 180 THEN '$FACTOR_VERY_LONG_LEAD$'
           WHEN lead_time > 90 THEN '$FACTOR_LONG_LEAD$' END,
      CASE WHEN deposit_type = 'No Deposit' THEN '$FACTOR_NO_DEPOSIT$' END,
      CASE WHEN previous_cancellations > 0 THEN '$FACTOR_PREV_CANCEL$' END,
      CASE WHEN total_of_special_requests = 0 THEN '$FACTOR_NO_REQUESTS$' END,
      CASE WHEN market_segment IN ('Online TA', 'Groups') THEN '$FACTOR_RISKY_SEGMENT_PREFIX$' || market_segment END,
      CASE WHEN distribution_channel = 'TA/TO' THEN '$FACTOR_TATO$' END,
      CASE WHEN required_car_parking_spaces = 0 THEN '$FACTOR_NO_PARKING$' END,
      CASE WHEN is_repeated_guest = 0 THEN '$FACTOR_NOT_REPEATED$' END
    ], lambda x: x IS NOT NULL) AS found, cancellation_probability
  FROM scored
), factors2 AS (
  SELECT booking_id, CASE WHEN len(found) = 0 AND cancellation_probability >= 0.8::DOUBLE
       THEN ['$FACTOR_GENERIC$'] ELSE found[1:5] END AS top_factors
  FROM factors
)
"""


@register("score_table", FACTORS_SQL + """
SELECT s.booking_id, ROUND(s.cancellation_probability, 6) AS cancellation_probability, s.risk_category,
  ROUND(s.deposit_loss_factor, 6) AS deposit_loss_factor, ROUND(s.expected_loss, 6) AS expected_loss,
  ROUND(s.business_priority_score, 6) AS business_priority_score, s.actionable,
  CASE WHEN s.actionable THEN '$FINANCIAL_PRIORITY_REVIEW$' ELSE '$FINANCIAL_PRIORITY_NONE$' END AS financial_priority,
  s.recommended_action, array_to_string(f.top_factors, ' | ') AS top_factors
FROM scored s JOIN factors2 f ON s.booking_id = f.booking_id
""")
def q_score_table(spark, sf):
    s = inputs.scored(spark, sf)
    return s.select(
        "booking_id", r6("cancellation_probability"), "risk_category", r6("deposit_loss_factor"), r6("expected_loss"),
        r6("business_priority_score"), "actionable", "financial_priority", "recommended_action",
        F.array_join("top_factors", " | ").alias("top_factors"),
    )


@register("factors_json", FACTORS_SQL + """
SELECT booking_id, to_json(top_factors) AS top_factors_json, len(top_factors) AS n_factors FROM factors2
""")
def q_factors_json(spark, sf):
    """Encode the factor list as JSON text and decode it back."""
    s = inputs.scored(spark, sf)
    enc = s.select("booking_id", F.to_json("top_factors").alias("top_factors_json"))
    dec = F.from_json("top_factors_json", "array<string>")
    return enc.select("booking_id", "top_factors_json", F.size(dec).cast("bigint").alias("n_factors"))


# ---------------------------------------------------------------------------
# insights (A2)
# ---------------------------------------------------------------------------

def _insight(group: str, with_risk: bool = True, top: int | None = None):
    def q(spark, sf):
        from ..operators.analyze import group_loss
        out = group_loss(inputs.scored(spark, sf), group, with_risk=with_risk, top=top)
        return out.select(group, "count", r6("expected_loss"), *([r6("avg_risk")] if with_risk else []))
    return q


def _insight_sql(group: str, with_risk: bool = True, top: int | None = None) -> str:
    risk = ", ROUND(AVG(cancellation_probability), 6) AS avg_risk" if with_risk else ""
    lim = f" ORDER BY expected_loss DESC, {group} LIMIT {top}" if top else ""
    return f"""
SELECT {group}, COUNT(booking_id) AS count, ROUND(SUM(expected_loss), 6) AS expected_loss{risk}
FROM scored GROUP BY {group}{lim}
"""


register("insights_risk", _insight_sql("risk_category"))(_insight("risk_category"))
register("insights_segment", _insight_sql("market_segment", top=10))(_insight("market_segment", top=10))
register("insights_country", _insight_sql("country", top=10))(_insight("country", top=10))
register("insights_deposit", _insight_sql("deposit_type"))(_insight("deposit_type"))
register("insights_actions", _insight_sql("recommended_action", with_risk=False))(
    _insight("recommended_action", with_risk=False))


def _load_all():
    """Import the query modules so that they register themselves."""
    from . import analysis_queries, dataset_queries, evaluation_queries, model_queries, ranking_queries, store_queries  # noqa: F401
