"""Ranking, top-k, prefix and binning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import right_closed_bin
from ..functions.constants import (
    NB_ADR_LABELS, NB_LEAD_EDGES, NB_LEAD_LABELS, NB_NIGHTS_EDGES, NB_NIGHTS_LABELS,
)
from ..operators import rank as R
from ..operators.business import PREDICTION_COLUMNS
from . import inputs
from .catalog import r6, register


@register("top_priority", """
SELECT booking_id, ROUND(business_priority_score, 6) AS business_priority_score, risk_category
FROM scored ORDER BY business_priority_score DESC NULLS LAST, booking_id LIMIT 20
""")
def q_top_priority(spark, sf):
    """O1 / O4 / O6"""
    s = inputs.scored(spark, sf)
    top = R.top_n(s, 20, R.priority_order(s))
    return top.select("booking_id", r6("business_priority_score"), "risk_category")


@register("top_risk", """
SELECT booking_id, ROUND(risk_score, 6) AS risk_score, ROUND(expected_loss, 6) AS expected_loss
FROM scored ORDER BY risk_score DESC, booking_id LIMIT 30
""")
def q_top_risk(spark, sf):
    """Top 30 by model risk"""
    s = inputs.scored(spark, sf)
    return R.top_n(s, 30, [F.desc("risk_score"), F.asc("booking_id")]).select(
        "booking_id", r6("risk_score"), r6("expected_loss"))


@register("worst_errors", """
(SELECT 'FP' AS error_type, booking_id, ROUND(risk_score, 6) AS risk_score FROM scored
 WHERE is_canceled = 0 AND risk_score >= 0.5 ORDER BY risk_score DESC, booking_id LIMIT 15)
UNION ALL
(SELECT 'FN' AS error_type, booking_id, ROUND(risk_score, 6) AS risk_score FROM scored
 WHERE is_canceled = 1 AND risk_score < 0.5 ORDER BY risk_score ASC, booking_id LIMIT 15)
""")
def q_worst_errors(spark, sf):
    """15 most confident false positives and false negatives"""
    s = inputs.scored(spark, sf)
    fp = R.top_n(s.where((F.col("is_canceled") == 0) & (F.col("risk_score") >= 0.5)), 15,
                 [F.desc("risk_score"), F.asc("booking_id")])
    fn = R.top_n(s.where((F.col("is_canceled") == 1) & (F.col("risk_score") < 0.5)), 15,
                 [F.asc("risk_score"), F.asc("booking_id")])
    cols = ["booking_id", r6("risk_score")]
    return (fp.select(F.lit("FP").alias("error_type"), *cols)
            .unionByName(fn.select(F.lit("FN").alias("error_type"), *cols)))


ECON_SQL = """
, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY business_priority_score DESC NULLS LAST, booking_id) AS rk,
               COUNT(*) OVER () AS n FROM scored),
sc(top_share) AS (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)),
k AS (SELECT top_share, GREATEST(1, CAST(FLOOR((SELECT COUNT(*) FROM scored) * top_share) AS BIGINT)) AS k FROM sc),
a AS (SELECT k.top_share, k.k, SUM(r.expected_loss) AS el,
             AVG(CASE WHEN r.deposit_type = 'No Deposit' THEN 1.0 ELSE 0.0 END) AS s_nd,
             AVG(CASE WHEN r.deposit_type = 'Non Refund' THEN 1.0 ELSE 0.0 END) AS s_nr
      FROM k JOIN r ON r.rk <= k.k GROUP BY k.top_share, k.k)
SELECT top_share, CAST(k AS DOUBLE) AS selected_bookings, ROUND(el, 6) AS expected_loss,
  ROUND(el * 0.25, 6) AS gross_protected_revenue, ROUND(k * 150.0, 6) AS intervention_cost,
  ROUND(el * 0.25 - k * 150.0, 6) AS net_effect, ROUND(s_nd, 6) AS share_no_deposit, ROUND(s_nr, 6) AS share_non_refund
FROM a
"""


@register("economics", ECON_SQL)
def q_economics(spark, sf):
    """A26 + O3: one row per top-share scenario"""
    e = R.economics(inputs.scored(spark, sf))
    return e.select("top_share", "selected_bookings", r6("expected_loss"), r6("gross_protected_revenue"),
                    r6("intervention_cost"), r6("net_effect"), r6("share_no_deposit"), r6("share_non_refund"))


@register("prefix_optimum", """
, r AS (SELECT ROW_NUMBER() OVER (ORDER BY business_priority_score DESC NULLS LAST, booking_id) AS k,
               SUM(GREATEST(COALESCE(expected_loss, 0), 0)) OVER (ORDER BY business_priority_score DESC NULLS LAST, booking_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_loss
        FROM scored WHERE actionable),
n AS (SELECT *, cum_loss * 0.25 - k * 150.0 AS net FROM r),
b AS (SELECT * FROM n ORDER BY net DESC, k LIMIT 1),
t AS (SELECT SUM(GREATEST(COALESCE(expected_loss, 0), 0)) AS total FROM scored WHERE actionable)
SELECT CASE WHEN ok THEN CAST(k AS DOUBLE) ELSE 0.0 END AS review_count,
  ROUND(CASE WHEN ok THEN cum_loss ELSE 0.0 END, 6) AS review_expected_loss,
  ROUND(CASE WHEN ok THEN cum_loss * 0.25 ELSE 0.0 END, 6) AS protected,
  ROUND(CASE WHEN ok THEN k * 150.0 ELSE 0.0 END, 6) AS cost,
  ROUND(CASE WHEN ok THEN net ELSE 0.0 END, 6) AS net
FROM (SELECT b.*, (t.total > 0 AND b.net > 0) AS ok FROM b, t)
""")
def q_prefix_optimum(spark, sf):
    """W3 on the actionable list"""
    o = R.prefix_optimum(inputs.scored(spark, sf), only="actionable")
    return o.select("review_count", r6("review_expected_loss"), r6("protected"), r6("cost"), r6("net"))


@register("rank_compare", """
, a AS (SELECT 'by_risk' AS sorting, * FROM scored ORDER BY risk_score DESC, booking_id LIMIT 20),
b AS (SELECT 'by_priority' AS sorting, * FROM scored ORDER BY business_priority_score DESC NULLS LAST, booking_id LIMIT 20),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT sorting, COUNT(*) AS n, ROUND(AVG(CASE WHEN deposit_type = 'Non Refund' THEN 1.0 ELSE 0.0 END), 6) AS share_non_refund,
  ROUND(AVG(CASE WHEN deposit_type = 'No Deposit' THEN 1.0 ELSE 0.0 END), 6) AS share_no_deposit,
  ROUND(SUM(expected_loss), 6) AS expected_loss
FROM u GROUP BY sorting
""")
def q_rank_compare(spark, sf):
    """Two top-20 rankings side by side"""
    s = inputs.scored(spark, sf)
    a = R.top_n(s, 20, [F.desc("risk_score"), F.asc("booking_id")]).withColumn("sorting", F.lit("by_risk"))
    b = R.top_n(s, 20, R.priority_order(s)).withColumn("sorting", F.lit("by_priority"))
    u = a.unionByName(b)
    return u.groupBy("sorting").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg((F.col("deposit_type") == "Non Refund").cast("double")), "share_non_refund"),
        r6(F.avg((F.col("deposit_type") == "No Deposit").cast("double")), "share_no_deposit"),
        r6(F.sum("expected_loss"), "expected_loss"))


@register("qcut_rank", """
, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY adr, booking_id) AS rn, COUNT(*) OVER () AS n FROM prepared),
b AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE GREATEST(1, CAST(CEIL((rn - 1) * 5.0 / (n - 1)) AS INT)) END AS bin FROM r)
SELECT bin, COUNT(*) AS rows, ROUND(MIN(adr), 6) AS min_adr, ROUND(MAX(adr), 6) AS max_adr,
  ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate FROM b GROUP BY bin
""")
def q_qcut_rank(spark, sf):
    """Equal-count bins on the unique rank of adr"""
    b = R.equal_count_bins(inputs.prepared(spark, sf), "adr", 5, keep=["is_canceled"])
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), r6(F.min("adr"), "min_adr"),
                                r6(F.max("adr"), "max_adr"), r6(F.avg("is_canceled"), "cancel_rate"))


@register("qcut_clip", """
, v AS (SELECT *, LEAST(GREATEST(adr, 0), 500) AS x FROM prepared),
e AS (SELECT list_sort(list_distinct([quantile_cont(x, 0.0), quantile_cont(x, 0.2), quantile_cont(x, 0.4),
        quantile_cont(x, 0.6), quantile_cont(x, 0.8), quantile_cont(x, 1.0)])) AS edges FROM v),
b AS (SELECT v.*, GREATEST(1, len(list_filter(e.edges, lambda t: t < v.x))) AS bin, e.edges FROM v, e)
SELECT bin, ROUND(edges[bin], 6) AS lower, ROUND(edges[bin + 1], 6) AS upper, COUNT(*) AS rows,
  ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate
FROM b GROUP BY bin, edges[bin], edges[bin + 1]
""")
def q_qcut_clip(spark, sf):
    """Quantile bins of clip(adr, 0, 500), duplicate edges dropped"""
    p = inputs.prepared(spark, sf)
    b = R.quantile_edge_bins(p, F.least(F.greatest(F.col("adr"), F.lit(0.0)), F.lit(500.0)), 5)
    return b.groupBy("bin", "bin_lower", "bin_upper").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.avg("is_canceled"), "cancel_rate")).select(
        "bin", r6("bin_lower", "lower"), r6("bin_upper", "upper"), "rows", "cancel_rate")


@register("chrono_split", """
SELECT booking_id, CASE WHEN rn <= FLOOR(n * 0.7) THEN 'train' WHEN rn <= FLOOR(n * 0.85) THEN 'valid' ELSE 'test' END AS chrono_split
FROM (SELECT booking_id, ROW_NUMBER() OVER (ORDER BY arrival_date NULLS LAST, booking_id) AS rn, COUNT(*) OVER () AS n FROM prepared)
""")
def q_chrono_split(spark, sf):
    """W7"""
    return R.chronological_split(inputs.prepared(spark, sf), keep=[]).select("booking_id", "chrono_split")


@register("month_order", """
SELECT arrival_date_month, CAST(arrival_month_num AS INT) AS month_num, COUNT(*) AS bookings,
  ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate FROM prepared GROUP BY 1, 2
""")
def q_month_order(spark, sf):
    """Custom category order (months by ordinal)"""
    p = inputs.prepared(spark, sf)
    return (p.groupBy("arrival_date_month", F.col("arrival_month_num").cast("int").alias("month_num"))
            .agg(F.count(F.lit(1)).alias("bookings"), r6(F.avg("is_canceled"), "cancel_rate"))
            .orderBy("month_num"))


@register("surrogate_ids", """
SELECT COUNT(*) AS rows, CAST(1 AS BIGINT) AS min_id, COUNT(*) AS max_id, COUNT(*) AS distinct_ids FROM bookings
""")
def q_surrogate_ids(spark, sf):
    """A table without ids gets 1..n (checked by its invariants)"""
    from ..operators.features import prepare_features
    p = prepare_features(inputs.raw(spark, sf).drop("booking_id"))
    return p.agg(F.count(F.lit(1)).alias("rows"), F.min("booking_id").alias("min_id"),
                 F.max("booking_id").alias("max_id"), F.count_distinct("booking_id").alias("distinct_ids"))


def _bin_sql(x: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"COALESCE(CASE {parts} END, 'nan')"


@register("booking_text", f"""
, t AS (SELECT *, stays_in_weekend_nights + stays_in_week_nights AS nights,
               ROW_NUMBER() OVER (ORDER BY adr, booking_id) AS rn, COUNT(*) OVER () AS n FROM bookings)
SELECT booking_id,
  'hotel ' || hotel || ' market ' || market_segment || ' channel ' || distribution_channel || ' deposit ' || deposit_type
  || ' customer ' || customer_type || ' room ' || reserved_room_type || ' lead ' || {_bin_sql('lead_time', NB_LEAD_EDGES, NB_LEAD_LABELS)}
  || ' nights ' || {_bin_sql('nights', NB_NIGHTS_EDGES, NB_NIGHTS_LABELS)}
  || ' adr adr_q' || CAST(GREATEST(1, CAST(CEIL((rn - 1) * 5.0 / (n - 1)) AS INT)) AS VARCHAR)
  || ' special_requests ' || CAST(total_of_special_requests AS VARCHAR) || ' repeated_guest ' || CAST(is_repeated_guest AS VARCHAR)
  AS booking_text
FROM t
""")
def q_booking_text(spark, sf):
    """Row to labelled text (input of the text + table model)"""
    from ..operators.text import booking_text
    return booking_text(inputs.raw(spark, sf)).select("booking_id", "booking_text")


@register("prediction_records", """
SELECT CAST(booking_id AS VARCHAR) AS booking_id, hotel, CAST(arrival_date AS VARCHAR) AS arrival_date, market_segment, distribution_channel,
  deposit_type, customer_type, ROUND(adr, 6) AS adr, ROUND(total_nights, 6) AS total_nights, ROUND(booking_value, 6) AS booking_value,
  ROUND(risk_score, 6) AS risk_score, ROUND(cancellation_probability, 6) AS cancellation_probability, risk_category,
  ROUND(expected_loss, 6) AS expected_loss, ROUND(business_priority_score, 6) AS business_priority_score,
  ROUND(deposit_loss_factor, 6) AS deposit_loss_factor, actionable,
  CASE WHEN actionable THEN '$FINANCIAL_PRIORITY_REVIEW$' ELSE '$FINANCIAL_PRIORITY_NONE$' END AS financial_priority, recommended_action
FROM scored ORDER BY business_priority_score DESC NULLS LAST, booking_id LIMIT 100
""")
def q_prediction_records(spark, sf):
    """P17 + X3 + O10: ranked output projection, id and date as text, first ``limit`` rows"""
    s = inputs.scored(spark, sf)
    top = R.top_n(s.select(*PREDICTION_COLUMNS), 100, R.priority_order(s))
    return top.select(F.col("booking_id").cast("string").alias("booking_id"), "hotel",
                      F.substring(F.col("arrival_date").cast("string"), 1, 10).alias("arrival_date"),
                      "market_segment", "distribution_channel", "deposit_type", "customer_type", r6("adr"), r6("total_nights"), r6("booking_value"),
                      r6("risk_score"), r6("cancellation_probability"), "risk_category", r6("expected_loss"), r6("business_priority_score"),
                      r6("deposit_loss_factor"), "actionable", "financial_priority", "recommended_action")


@register("preview", """
SELECT booking_id, hotel, ROUND(lead_time, 6) AS lead_time, arrival_date, ROUND(adr, 6) AS adr,
  ROUND(total_nights, 6) AS total_nights, ROUND(booking_value, 6) AS booking_value, market_segment, deposit_type, country
FROM prepared ORDER BY booking_id LIMIT 10
""")
def q_preview(spark, sf):
    """10 prepared rows x 10 columns"""
    p = inputs.prepared(spark, sf)
    return R.top_n(p, 10, [F.asc("booking_id")]).select(
        "booking_id", "hotel", r6("lead_time"), "arrival_date", r6("adr"), r6("total_nights"), r6("booking_value"),
        "market_segment", "deposit_type", "country")


@register("single_lookup", """
SELECT booking_id, risk_category, ROUND(expected_loss, 6) AS expected_loss, recommended_action FROM scored
WHERE booking_id = (SELECT booking_id FROM scored ORDER BY business_priority_score DESC NULLS LAST, booking_id LIMIT 1)
""")
def q_single_lookup(spark, sf):
    """The booking card of the top-priority booking (its id, one row, is looked up)"""
    from ..operators.filters import lookup
    s = inputs.scored(spark, sf)
    top = R.top_n(s, 1, R.priority_order(s)).select("booking_id").first()
    card = lookup(s, top["booking_id"] if top else None)
    return card.select("booking_id", "risk_category", r6("expected_loss"), "recommended_action")


@register("recoerce", """
SELECT CAST(booking_id AS VARCHAR) AS booking_id, ROUND(risk_score, 6) AS risk_score,
  ROUND(cancellation_probability, 6) AS cancellation_probability, ROUND(booking_value, 6) AS booking_value
FROM scored
""")
def q_recoerce(spark, sf):
    """P25: stored text predictions back to numbers (bad text -> 0, probability falls back to score)"""
    from ..operators.store import predictions_to_frame
    s = inputs.scored(spark, sf)
    as_text = s.select(*[F.col(c).cast("string").alias(c) for c in
                         ["booking_id", "risk_score", "cancellation_probability", "booking_value"]])
    back = predictions_to_frame(as_text)
    return back.select("booking_id", r6("risk_score"), r6("cancellation_probability"), r6("booking_value"))
