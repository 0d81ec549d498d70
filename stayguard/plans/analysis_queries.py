"""Analysis queries (A1-A24, A31-A33, P13, P19, P20, U1, J5, J6) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import lead_time_bin, year_month
from ..functions.constants import LEAD_TIME_EDGES, LEAD_TIME_LABELS, LEAKAGE_COLUMNS
from ..operators import analyze as A
from ..operators import business as B
from ..operators.features import prepare_features
from . import inputs
from .catalog import r6, register

RAW_COLUMNS = [
    "booking_id", "hotel", "is_canceled", "reservation_status", "lead_time", "booking_creation_date", "arrival_date",
    "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children", "babies", "meal", "country",
    "market_segment", "distribution_channel", "is_repeated_guest", "previous_cancellations",
    "previous_bookings_not_canceled", "reserved_room_type", "deposit_type", "customer_type", "agent", "company_raw",
    "adr", "required_car_parking_spaces", "total_of_special_requests", "split",
]

LEAD_BIN_SQL = "CASE " + " ".join(f"WHEN lead_time > {lo} AND lead_time <= {hi} THEN '{name}'" for lo, hi, name in zip(
    LEAD_TIME_EDGES[:-1], LEAD_TIME_EDGES[1:], LEAD_TIME_LABELS)) + " END"


def _rate_sql(group_expr: str, alias: str, min_count: int = 1) -> str:
    return f"""
, g AS (SELECT {group_expr} AS {alias}, COUNT(*) AS count, CAST(SUM(is_canceled) AS BIGINT) AS cancellations,
               AVG(CAST(is_canceled AS DOUBLE)) AS cancel_rate FROM prepared GROUP BY 1)
SELECT {alias}, count, cancellations, ROUND(cancel_rate, 6) AS cancel_rate,
       ROUND(count / (SELECT SUM(count) FROM g), 6) AS share_of_rows
FROM g WHERE count >= {min_count}
"""


def _rate_out(df):
    return df.select(df.columns[0], "count", "cancellations", r6("cancel_rate"), r6("share_of_rows"))


@register("rate_table_segment", _rate_sql("market_segment", "market_segment"))
def q_rate_table_segment(spark, sf):
    return _rate_out(A.rate_table(inputs.prepared(spark, sf), "market_segment"))


@register("rate_table_lead_bin", _rate_sql(LEAD_BIN_SQL, "lead_time_bin"))
def q_rate_table_lead_bin(spark, sf):
    return _rate_out(A.rate_table(inputs.prepared(spark, sf), lead_time_bin(F.col("lead_time")).alias("lead_time_bin")))


@register("rate_table_country", _rate_sql("country", "country", 200))
def q_rate_table_country(spark, sf):
    return _rate_out(A.rate_table(inputs.prepared(spark, sf), "country", min_count=200))


@register("batch_summary", """
SELECT COUNT(*) AS rows, ROUND(AVG(cancellation_probability), 6) AS avg_risk_score,
  COUNT(*) FILTER (WHERE risk_category IN ('High', 'Critical')) AS high_or_critical,
  COUNT(*) FILTER (WHERE actionable) AS actionable_count,
  ROUND(SUM(expected_loss), 6) AS expected_loss_total,
  ROUND(COALESCE(SUM(expected_loss) FILTER (WHERE actionable), 0), 6) AS actionable_expected_loss_total,
  ROUND(SUM(booking_value), 6) AS booking_value_total,
  (SELECT string_agg(risk_category || '=' || n, ';' ORDER BY risk_category)
     FROM (SELECT risk_category, COUNT(*) AS n FROM scored GROUP BY 1)) AS category_counts
FROM scored
""")
def q_batch_summary(spark, sf):
    s = B.batch_summary(inputs.scored(spark, sf))
    entries = F.array_sort(F.map_entries("category_counts"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return s.select("rows", r6("avg_risk_score"), "high_or_critical", "actionable_count", r6("expected_loss_total"),
                    r6("actionable_expected_loss_total"), r6("booking_value_total"), text.alias("category_counts"))


@register("batch_header", """
SELECT COUNT(*) AS row_count, COUNT(*) FILTER (WHERE risk_category IN ('High', 'Critical')) AS high_risk_count,
  ROUND(SUM(booking_value), 6) AS total_booking_value,
  ROUND(COALESCE(SUM(expected_loss) FILTER (WHERE risk_category IN ('High', 'Critical')), 0), 6) AS total_expected_loss
FROM scored
""")
def q_batch_header(spark, sf):
    h = B.batch_header(inputs.scored(spark, sf))
    return h.select("row_count", "high_risk_count", r6("total_booking_value"), r6("total_expected_loss"))


@register("kpi_strip", """
, k AS (
  SELECT SUM(booking_value) AS total_revenue, SUM(expected_loss) AS expected_loss_all,
    AVG(cancellation_probability) AS avg_risk,
    SUM(LEAST(GREATEST(cancellation_probability, 0), 1) * GREATEST(booking_value, 0)
        * (1 - LEAST(GREATEST(deposit_loss_factor, 0), 1))) AS tariff_protected,
    COUNT(*) FILTER (WHERE actionable) AS review_count,
    COALESCE(SUM(expected_loss) FILTER (WHERE actionable), 0) AS review_expected_loss
  FROM scored)
SELECT ROUND(total_revenue, 6) AS total_revenue, ROUND(expected_loss_all, 6) AS expected_loss_all,
  ROUND(avg_risk, 6) AS avg_risk, ROUND(tariff_protected, 6) AS tariff_protected, review_count,
  ROUND(review_expected_loss, 6) AS review_expected_loss, ROUND(review_expected_loss * 0.25, 6) AS protected,
  ROUND(review_count * 150.0, 6) AS cost, ROUND(review_expected_loss * 0.25 - review_count * 150.0, 6) AS net,
  ROUND(CASE WHEN expected_loss_all > 0 THEN review_expected_loss / expected_loss_all ELSE 0 END, 6) AS loss_concentration
FROM k
""")
def q_kpi_strip(spark, sf):
    k = B.kpi_strip(inputs.scored(spark, sf))
    return k.select(r6("total_revenue"), r6("expected_loss_all"), r6("avg_risk"), r6("tariff_protected"),
                    "review_count", r6("review_expected_loss"), r6("protected"), r6("cost"), r6("net"),
                    r6("loss_concentration"))


@register("deposit_table", """
SELECT deposit_type, COUNT(booking_id) AS bookings, ROUND(AVG(cancellation_probability), 6) AS avg_risk,
  ROUND(SUM(booking_value), 6) AS booking_value_sum, ROUND(SUM(expected_loss), 6) AS expected_loss
FROM scored GROUP BY deposit_type
""")
def q_deposit_table(spark, sf):
    """A8"""
    s = inputs.scored(spark, sf)
    return s.groupBy("deposit_type").agg(
        F.count("booking_id").alias("bookings"), r6(F.avg("cancellation_probability"), "avg_risk"),
        r6(F.sum("booking_value"), "booking_value_sum"), r6(F.sum("expected_loss"), "expected_loss"))


@register("split_summary", """
SELECT split, COUNT(*) AS rows, ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate,
  MIN(arrival_date) AS min_arrival, MAX(arrival_date) AS max_arrival,
  MIN(booking_creation_date) AS min_created, MAX(booking_creation_date) AS max_created,
  ROUND(SUM(booking_value), 6) AS booking_value_sum
FROM prepared GROUP BY split
""")
def q_split_summary(spark, sf):
    """A9"""
    p = inputs.prepared(spark, sf)
    return p.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.avg("is_canceled"), "cancel_rate"),
        F.min("arrival_date").alias("min_arrival"), F.max("arrival_date").alias("max_arrival"),
        F.min("booking_creation_date").alias("min_created"), F.max("booking_creation_date").alias("max_created"),
        r6(F.sum("booking_value"), "booking_value_sum"))


@register("split_hotel", """
SELECT split, hotel, COUNT(*) AS rows, ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate
FROM prepared GROUP BY split, hotel
""")
def q_split_hotel(spark, sf):
    """A10"""
    p = inputs.prepared(spark, sf)
    return p.groupBy("split", "hotel").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("is_canceled"), "cancel_rate"))


@register("revenue_at_risk", """
SELECT market_segment, COUNT(*) AS bookings, ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate,
  ROUND(SUM(booking_value), 6) AS total_booking_value,
  ROUND(COALESCE(SUM(CASE WHEN is_canceled = 1 THEN booking_value END), 0), 6) AS canceled_booking_value,
  ROUND(AVG(booking_value), 6) AS mean_booking_value
FROM prepared WHERE booking_value >= 0 AND booking_value IS NOT NULL AND market_segment IS NOT NULL
GROUP BY market_segment
""")
def q_revenue_at_risk(spark, sf):
    """NULL keys dropped, canceled value as a conditional sum."""
    p = inputs.prepared(spark, sf)
    p = p.where((F.col("booking_value") >= 0) & F.col("market_segment").isNotNull())
    return p.groupBy("market_segment").agg(
        F.count(F.lit(1)).alias("bookings"), r6(F.avg("is_canceled"), "cancel_rate"),
        r6(F.sum("booking_value"), "total_booking_value"),
        r6(F.coalesce(F.sum(F.when(F.col("is_canceled") == 1, F.col("booking_value"))), F.lit(0.0)),
           "canceled_booking_value"),
        r6(F.avg("booking_value"), "mean_booking_value"))


@register("monthly_hotel", """
SELECT strftime(date_trunc('month', arrival_date), '%Y-%m') AS month, hotel, COUNT(*) AS bookings,
  CAST(SUM(is_canceled) AS BIGINT) AS cancellations, ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate
FROM prepared GROUP BY 1, 2
""")
def q_monthly_hotel(spark, sf):
    """A12 + D9"""
    p = inputs.prepared(spark, sf)
    return p.groupBy(year_month(F.trunc("arrival_date", "MM")).alias("month"), "hotel").agg(
        F.count(F.lit(1)).alias("bookings"), F.sum(F.col("is_canceled").cast("long")).alias("cancellations"),
        r6(F.avg("is_canceled"), "cancel_rate"))


@register("value_counts", """
, g AS (SELECT deposit_type, COUNT(*) AS count FROM bookings GROUP BY 1)
SELECT deposit_type, count, ROUND(count / (SELECT SUM(count) FROM g), 6) AS share FROM g
""")
def q_value_counts(spark, sf):
    """A13"""
    v = A.value_counts(inputs.raw(spark, sf), "deposit_type")
    return v.select("deposit_type", "count", r6("share"))


def _union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@register("missing_report", _union_sql([
    f"SELECT '{c}' AS column, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*), 6) AS missing_share FROM bookings" for c in RAW_COLUMNS]))
def q_missing_report(spark, sf):
    """A14"""
    m = A.missing_report(inputs.raw(spark, sf), RAW_COLUMNS)
    return m.select("column", "missing", r6("missing_share"))


@register("column_profile", _union_sql([
    f"SELECT '{c}' AS column, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*), 6) AS missing_rate, "
    f"CAST(COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique FROM bookings"
    for c in RAW_COLUMNS]))
def q_column_profile(spark, sf):
    """A15 (the engine-specific dtype name is left out of the comparison)"""
    p = A.column_profile(inputs.raw(spark, sf), RAW_COLUMNS)
    return p.select("column", "missing", r6("missing_rate"), "n_unique")


DESCRIBE_COLS = ["lead_time", "adr", "total_nights", "total_guests", "booking_value"]


@register("describe", _union_sql([
    f"SELECT '{c}' AS column, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std, "
    f"ROUND(MIN({c}), 6) AS min, ROUND(quantile_cont({c}, 0.01), 6) AS p01, ROUND(quantile_cont({c}, 0.05), 6) AS p05, "
    f"ROUND(quantile_cont({c}, 0.5), 6) AS p50, ROUND(quantile_cont({c}, 0.95), 6) AS p95, "
    f"ROUND(quantile_cont({c}, 0.99), 6) AS p99, ROUND(MAX({c}), 6) AS max FROM prepared" for c in DESCRIBE_COLS]))
def q_describe(spark, sf):
    """A16"""
    d = A.describe(inputs.prepared(spark, sf), DESCRIBE_COLS, "booking_id")
    return d.select("column", "count", *[r6(c) for c in ["mean", "std", "min", "p01", "p05", "p50", "p95", "p99", "max"]])


@register("quality_checks", """
, q AS (
  SELECT COUNT(*) AS n,
    COUNT(*) FILTER (WHERE arrival_date IS NULL) AS c0,
    COUNT(*) FILTER (WHERE adults + children + babies = 0) AS c1,
    COUNT(*) FILTER (WHERE stays_in_weekend_nights + stays_in_week_nights = 0) AS c2,
    COUNT(*) FILTER (WHERE adr < 0) AS c3,
    COUNT(*) FILTER (WHERE lead_time < 0) AS c4,
    COUNT(*) FILTER (WHERE adr * (stays_in_weekend_nights + stays_in_week_nights) < 0) AS c5
  FROM bookings)
SELECT 'arrival_date is missing' AS "check", c0 AS count, ROUND(c0 / n, 6) AS share FROM q UNION ALL
SELECT 'total_guests == 0', c1, ROUND(c1 / n, 6) FROM q UNION ALL
SELECT 'total_nights == 0', c2, ROUND(c2 / n, 6) FROM q UNION ALL
SELECT 'adr < 0', c3, ROUND(c3 / n, 6) FROM q UNION ALL
SELECT 'lead_time < 0', c4, ROUND(c4 / n, 6) FROM q UNION ALL
SELECT 'booking_value < 0', c5, ROUND(c5 / n, 6) FROM q
""")
def q_quality_checks(spark, sf):
    """A17"""
    return A.quality_checks(inputs.raw(spark, sf)).select("check", "count", r6("share"))


@register("sanity_filter", """
SELECT booking_id, split FROM bookings
WHERE adults + COALESCE(children, 0) + babies > 0 AND stays_in_weekend_nights + stays_in_week_nights > 0
  AND adr >= 0 AND arrival_date IS NOT NULL
""")
def q_sanity_filter(spark, sf):
    """P13"""
    return A.sanity_filter(inputs.raw(spark, sf)).select("booking_id", "split")


@register("pivot_segment_hotel", """
SELECT market_segment,
  ROUND(AVG(CASE WHEN hotel = 'City Hotel' THEN CAST(is_canceled AS DOUBLE) END), 6) AS "City Hotel",
  ROUND(AVG(CASE WHEN hotel = 'Resort Hotel' THEN CAST(is_canceled AS DOUBLE) END), 6) AS "Resort Hotel"
FROM prepared GROUP BY market_segment
""")
def q_pivot_segment_hotel(spark, sf):
    """A19"""
    pv = A.pivot_mean(inputs.prepared(spark, sf), "market_segment", "hotel", "is_canceled",
                      ["City Hotel", "Resort Hotel"])
    return pv.select("market_segment", r6("City Hotel"), r6("Resort Hotel"))


@register("crosstab_deposit_status", """
SELECT deposit_type,
  ROUND(COUNT(*) FILTER (WHERE reservation_status = 'Canceled') / COUNT(*), 6) AS "Canceled",
  ROUND(COUNT(*) FILTER (WHERE reservation_status = 'Check-Out') / COUNT(*), 6) AS "Check-Out",
  ROUND(COUNT(*) FILTER (WHERE reservation_status = 'No-Show') / COUNT(*), 6) AS "No-Show"
FROM bookings GROUP BY deposit_type
""")
def q_crosstab(spark, sf):
    """A20"""
    levels = ["Canceled", "Check-Out", "No-Show"]
    ct = A.crosstab_normalized(inputs.raw(spark, sf), "deposit_type", "reservation_status", levels)
    return ct.select("deposit_type", *[r6(F.col(f"`{lv}`"), lv) for lv in levels])


@register("status_consistency", """
SELECT is_canceled, reservation_status, COUNT(*) AS count FROM bookings GROUP BY 1, 2
""")
def q_status_consistency(spark, sf):
    """A21"""
    return inputs.raw(spark, sf).groupBy("is_canceled", "reservation_status").agg(F.count(F.lit(1)).alias("count"))


@register("leakage_audit", _union_sql([
    f"SELECT '{c}' AS column, CAST(COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique, "
    f"ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*), 6) AS missing_share, "
    f"'{'drop: post-factum' if c in LEAKAGE_COLUMNS else ('target' if c == 'is_canceled' else 'keep')}' AS decision "
    f"FROM bookings" for c in RAW_COLUMNS]))
def q_leakage_audit(spark, sf):
    """A22"""
    la = A.leakage_audit(inputs.raw(spark, sf).select(*RAW_COLUMNS), LEAKAGE_COLUMNS)
    return la.select("column", "n_unique", r6("missing_share"), "decision")


@register("domain_complete_bins", f"""
, bins(bin, bin_order) AS (VALUES {", ".join(f"('{b}', {i})" for i, b in enumerate(LEAD_TIME_LABELS))}),
src AS (SELECT DISTINCT split AS source FROM prepared),
cnt AS (SELECT split AS source, {LEAD_BIN_SQL} AS bin, COUNT(*) AS n FROM prepared GROUP BY 1, 2)
SELECT s.source, b.bin, CAST(b.bin_order AS INT) AS bin_order, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM src s CROSS JOIN bins b LEFT JOIN cnt c ON c.source = s.source AND c.bin = b.bin
""")
def q_domain_complete_bins(spark, sf):
    """A23"""
    p = inputs.prepared(spark, sf)
    return A.domain_complete_counts(p, "split", lead_time_bin(F.col("lead_time")), LEAD_TIME_LABELS)


@register("error_by_segment", """
, e AS (
  SELECT CASE WHEN is_canceled = 1 AND risk_score >= 0.5 THEN 'TP' WHEN is_canceled = 0 AND risk_score < 0.5 THEN 'TN'
              WHEN is_canceled = 0 AND risk_score >= 0.5 THEN 'FP' ELSE 'FN' END AS error_type, hotel, deposit_type
  FROM scored),
c AS (SELECT error_type, hotel, deposit_type, COUNT(*) AS count FROM e GROUP BY 1, 2, 3)
SELECT error_type, hotel, deposit_type, count,
  ROUND(count / SUM(count) OVER (PARTITION BY error_type), 6) AS share_in_group
FROM c
""")
def q_error_by_segment(spark, sf):
    """A24 + B9 + W4"""
    from ..functions.rules import error_type
    s = inputs.scored(spark, sf)
    e = s.withColumn("error_type", error_type(F.col("is_canceled"), (F.col("risk_score") >= 0.5).cast("int")))
    out = A.share_within(e, ["error_type", "hotel", "deposit_type"], ["error_type"])
    return out.select("error_type", "hotel", "deposit_type", "count", r6("share_in_group"))


PROFILE_DIMS = ["hotel", "market_segment", "distribution_channel", "deposit_type", "customer_type", "meal",
                "reserved_room_type", "arrival_season", "arrival_date_month", "total_of_special_requests",
                "lead_time_bin"]


@register("segment_profile", _union_sql([
    f"SELECT '{d}' AS dimension, CAST({LEAD_BIN_SQL if d == 'lead_time_bin' else d} AS VARCHAR) AS value, "
    "COUNT(*) AS rows, ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate, ROUND(AVG(adr), 6) AS mean_adr, "
    "ROUND(SUM(booking_value), 6) AS booking_value_sum FROM prepared GROUP BY 2" for d in PROFILE_DIMS]))
def q_segment_profile(spark, sf):
    """A31"""
    p = inputs.prepared(spark, sf).withColumn("lead_time_bin", lead_time_bin(F.col("lead_time")))
    out = A.segment_profile(p, PROFILE_DIMS)
    return out.select("dimension", "value", "rows", r6("cancel_rate"), r6("mean_adr"), r6("booking_value_sum"))


FILTER_COLS = ["hotel", "market_segment", "distribution_channel", "risk_category"]


@register("filter_options", _union_sql([
    f"SELECT DISTINCT '{c}' AS column, CAST({c} AS VARCHAR) AS value, "
    + ("CAST(CASE " + " ".join(f"WHEN {c} = '{v}' THEN {i + 1}" for i, v in enumerate(["Critical", "High", "Medium", "Low"]))
       + " ELSE 5 END AS INT)" if c == "risk_category" else "CAST(5 AS INT)")
    + f" AS severity_rank FROM scored WHERE {c} IS NOT NULL" for c in FILTER_COLS]))
def q_filter_options(spark, sf):
    """A32"""
    return A.filter_options(inputs.scored(spark, sf), FILTER_COLS)


@register("class_weights", """
, c AS (SELECT is_canceled, COUNT(*) AS count FROM bookings WHERE split = 'train' GROUP BY 1)
SELECT is_canceled, count, ROUND((SELECT SUM(count) FROM c) / ((SELECT COUNT(*) FROM c) * count), 6) AS weight FROM c
""")
def q_class_weights(spark, sf):
    """A33 on the train split (weights are a training input)"""
    w = A.class_weights(inputs.raw(spark, sf).where(F.col("split") == "train"))
    return w.select("is_canceled", "count", r6("weight"))


# ---------------------------------------------------------------------------
# filters and semi / anti joins on the scored table
# ---------------------------------------------------------------------------

@register("multi_filter", """
SELECT booking_id, ROUND(expected_loss, 6) AS expected_loss FROM scored
WHERE hotel IN ('City Hotel') AND market_segment IN ('Online TA', 'Groups', 'Offline TA/TO')
  AND risk_category IN ('High', 'Critical', 'Medium') AND expected_loss >= 100
""")
def q_multi_filter(spark, sf):
    """P19 (an empty selection list means no filter: here the channel list is empty)"""
    from ..operators.filters import multi_filter
    s = inputs.scored(spark, sf)
    f = multi_filter(s, hotels=["City Hotel"], segments=["Online TA", "Groups", "Offline TA/TO"], channels=[],
                     categories=["High", "Critical", "Medium"], min_loss=100.0)
    return f.select("booking_id", r6("expected_loss"))


@register("horizon_filter", """
SELECT booking_id, arrival_date FROM scored
WHERE arrival_date >= (SELECT MIN(arrival_date) FROM scored)
  AND arrival_date <= (SELECT MIN(arrival_date) FROM scored) + INTERVAL 30 DAY
""")
def q_horizon_filter(spark, sf):
    """P20: horizon counted from the earliest arrival of the whole table"""
    from ..operators.filters import arrival_horizon
    return arrival_horizon(inputs.scored(spark, sf), 30).select("booking_id", "arrival_date")


@register("semi_recommended", """
SELECT booking_id, hotel, ROUND(expected_loss, 6) AS expected_loss FROM scored
WHERE booking_id IN (SELECT booking_id FROM scored WHERE actionable)
""")
def q_semi_recommended(spark, sf):
    """Rows of the view whose id is on the recommended (actionable) list"""
    s = inputs.scored(spark, sf)
    ids = s.where("actionable").select("booking_id")
    return s.join(ids, "booking_id", "left_semi").select("booking_id", "hotel", r6("expected_loss"))


HASH_SQL = "CAST('0x' || substr(md5('{seed}:' || CAST(booking_id AS VARCHAR)), 1, 15) AS BIGINT)"


@register("anti_remainder", f"""
, t AS (SELECT booking_id FROM bookings WHERE ({HASH_SQL.format(seed=42)}) % 100 < 20)
SELECT booking_id, 'test' AS part FROM t
UNION ALL
SELECT booking_id, 'rest' AS part FROM bookings WHERE booking_id NOT IN (SELECT booking_id FROM t)
""")
def q_anti_remainder(spark, sf):
    """J6 + U4: seeded hash sample of 20 % and its remainder by anti-join"""
    from ..operators.filters import hash_bucket
    raw = inputs.raw(spark, sf)
    test = raw.where(hash_bucket(F.col("booking_id"), 42) < 20).select("booking_id")
    rest = raw.select("booking_id").join(test, "booking_id", "left_anti")
    return test.withColumn("part", F.lit("test")).unionByName(rest.withColumn("part", F.lit("rest")))


@register("seeded_sample", f"""
SELECT booking_id, hotel FROM bookings ORDER BY {HASH_SQL.format(seed=7)}, booking_id LIMIT 500
""")
def q_seeded_sample(spark, sf):
    """Reproducible sample of at most N rows (independent of partitioning)"""
    from ..operators.filters import seeded_sample
    return seeded_sample(inputs.raw(spark, sf), 500, seed=7).select("booking_id", "hotel")


@register("validation_report", """
SELECT COUNT(*) AS row_count, 28 AS column_count, 'green' AS quality_status, 1.0::DOUBLE AS schema_confidence,
  0.0::DOUBLE AS defaulted_ratio, '' AS defaulted_columns, 'reservation_status' AS leakage_removed,
  'booking_creation_date, country, split' AS ignored_columns,
  '$WARNING_TARGET$ | '
  || '$WARNING_LEAKAGE$reservation_status | '
  || '$WARNING_IGNORED$booking_creation_date, country, split' AS warnings
FROM bookings
""")
def q_validation_report(spark, sf):
    """P1-P6 + X6: schema mapping and quality grade of the booking view (strict mode);
    only the row count needs a job, the rest is driver-side metadata"""
    from ..operators.schema import validate_input
    v = validate_input(spark, inputs.raw(spark, sf), allow_defaults=False)
    return v.select("row_count", "column_count", "quality_status", "schema_confidence", "defaulted_ratio",
                    F.array_join("defaulted_columns", ", ").alias("defaulted_columns"),
                    F.array_join("leakage_removed", ", ").alias("leakage_removed"),
                    F.array_join("ignored_columns", ", ").alias("ignored_columns"),
                    F.array_join("warnings", " | ").alias("warnings"))
