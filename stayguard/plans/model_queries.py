"""Queries for the older rule set, baselines, learned models and the file stream
(B7, M2, M10-M17, M19-M23, R1, R2).

Fitted models have no SQL twin: those queries are registered without an oracle. What they
are fitted from (medians, categories, scales) and conditions that their fits must meet
(zero gradient, block means) are compared with SQL.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.constants import DEPOSIT_LOSS_FACTOR_NOTEBOOK
from ..functions.rules import deposit_loss_factor, notebook_action, notebook_rule_score, notebook_why_risky, risk_category
from ..operators import evaluate as EV
from ..operators import models as M
from . import inputs
from .catalog import r6, register


@register("notebook_rules", """
SELECT booking_id, risk_category,
  ROUND(CASE deposit_type WHEN 'No Deposit' THEN 1.0::DOUBLE WHEN 'Refundable' THEN 0.8::DOUBLE WHEN 'Non Refund' THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END, 6)
    AS deposit_loss_factor,
  ROUND(risk_score * booking_value * CASE deposit_type WHEN 'No Deposit' THEN 1.0::DOUBLE WHEN 'Refundable' THEN 0.8::DOUBLE
        WHEN 'Non Refund' THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END, 6) AS expected_loss,
  CASE WHEN total_of_special_requests = 0 AND required_car_parking_spaces = 0 THEN '$NB_WHY_NO_REQUESTS$'
       WHEN lead_time > 90 THEN '$NB_WHY_LONG_LEAD$' WHEN previous_cancellations > 0 THEN '$FACTOR_PREV_CANCEL$'
       ELSE '$NB_WHY_DEFAULT$' END AS why_risky,
  CASE WHEN deposit_type = 'Non Refund' THEN '$NB_ACTION_NON_REFUND$'
       WHEN risk_category IN ('Critical', 'High') AND deposit_type = 'No Deposit' THEN '$NB_ACTION_NO_DEPOSIT$'
       WHEN risk_category IN ('Critical', 'High') AND deposit_type = 'Refundable' THEN '$NB_ACTION_REFUNDABLE$'
       WHEN risk_category = 'Medium' THEN '$NB_ACTION_MEDIUM$'
       ELSE '$NB_ACTION_NONE$' END AS recommended_action
FROM scored
""")
def q_notebook_rules(spark, sf):
    """The older rule set (factor 1 / .80 / .05, action by deposit, first-match reason)"""
    s = inputs.scored(spark, sf)
    f = deposit_loss_factor(F.col("deposit_type"), DEPOSIT_LOSS_FACTOR_NOTEBOOK)
    cat = risk_category(F.col("risk_score"))
    return s.select("booking_id", cat.alias("risk_category"), r6(f, "deposit_loss_factor"),
                    r6(F.col("risk_score") * F.col("booking_value") * f, "expected_loss"),
                    notebook_why_risky().alias("why_risky"),
                    notebook_action(cat, F.col("deposit_type")).alias("recommended_action"))


@register("rule_score_normalized", """
, s AS (SELECT booking_id,
    0.0::DOUBLE + CASE WHEN lead_time > 90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN deposit_type = 'No Deposit' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN previous_cancellations > 0 THEN 1.3::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN total_of_special_requests = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN required_car_parking_spaces = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN market_segment IN ('Online TA', 'Groups', 'Offline TA/TO') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS raw
  FROM prepared)
SELECT booking_id, ROUND(raw / GREATEST(1.0, (SELECT MAX(raw) FROM s)), 6) AS notebook_score FROM s
""")
def q_rule_score_normalized(spark, sf):
    """M2 + J7: notebook rule score divided by max(1, the set maximum), the maximum broadcast as one row"""
    p = inputs.prepared(spark, sf).withColumn("_raw", notebook_rule_score())
    mx = p.agg(F.greatest(F.lit(1.0), F.max("_raw")).alias("_max"))
    return p.crossJoin(F.broadcast(mx)).select("booking_id", r6(F.col("_raw") / F.col("_max"), "notebook_score"))


@register("baseline_delta", """
, pr AS (SELECT AVG(CAST(is_canceled AS DOUBLE)) AS prior FROM scored WHERE split = 'train'),
m AS (SELECT split, AVG(POWER(risk_score - is_canceled, 2)) AS brier_rule,
             AVG(POWER(pr.prior - is_canceled, 2)) AS brier_prior FROM scored, pr GROUP BY split)
SELECT split, ROUND(brier_rule, 6) AS brier_rule, ROUND(brier_prior, 6) AS brier_prior,
  ROUND(brier_rule - brier_prior, 6) AS brier_delta FROM m
""")
def q_baseline_delta(spark, sf):
    """M14 + M20: constant train-prior baseline and the metric delta of the rule score against it"""
    s = inputs.scored(spark, sf)
    prior = s.where(F.col("split") == "train").agg(F.avg(F.col("is_canceled").cast("double")).alias("prior"))
    with_prior = s.crossJoin(F.broadcast(prior))
    rule = EV.brier(with_prior, "is_canceled", "risk_score", ["split"]).withColumnRenamed("brier", "brier_rule")
    base = EV.brier(with_prior, "is_canceled", "prior", ["split"]).withColumnRenamed("brier", "brier_prior")
    d = rule.join(base, "split")
    return d.select("split", r6("brier_rule"), r6("brier_prior"), r6(F.col("brier_rule") - F.col("brier_prior"),
                                                                      "brier_delta"))


# ---------------------------------------------------------------------------
# learned models
# ---------------------------------------------------------------------------

def _trained(spark, sf, calibration="platt"):
    """The engine's own candidates, fitted on all train rows; one training per session, folder and calibration."""
    return inputs.memo(spark, sf, f"model-{calibration}", lambda: M.train_model(
        inputs.prepared(spark, sf), calibration=calibration))


@register("model_train_metrics")
def q_model_train_metrics(spark, sf):
    """Candidate search on valid, Platt calibration, test metrics (one row)"""
    m = _trained(spark, sf).metrics
    row = [(m["model"], m["roc_auc"], m["pr_auc"], m["brier"], m["roc_auc_raw"], m["pr_auc_raw"], m["brier_raw"],
            m["precision@20"], m["recall@20"], m["lift@20"], len(m["candidate_metrics"]))]
    return spark.createDataFrame(row, "model string, roc_auc double, pr_auc double, brier double, roc_auc_raw double, "
                                      "pr_auc_raw double, brier_raw double, precision_at_20 double, "
                                      "recall_at_20 double, lift_at_20 double, candidates int")


@register("model_leaderboard")
def q_model_leaderboard(spark, sf):
    """U2 + M17 + N15: every candidate with its validation metrics and selection score, best first"""
    rows = [(r["name"], r["valid_roc_auc"], r["valid_pr_auc"], r["valid_lift@20"], r["selection_score"]) for r in _trained(spark, sf).metrics["candidate_metrics"]]
    board = spark.createDataFrame(rows, "name string, valid_roc_auc double, valid_pr_auc double, valid_lift_at_20 double, selection_score double")
    return board.orderBy(F.desc("selection_score"), "name")


@register("model_scores")
def q_model_scores(spark, sf):
    """Every booking scored by the trained, calibrated model (isotonic calibration, M16)"""
    return M.predict(_trained(spark, sf, "isotonic"), inputs.prepared(spark, sf)).select(
        "booking_id", r6("risk_score"), r6("cancellation_probability"), "risk_category", r6("expected_loss"))


@register("metric_deltas", """
, pr AS (SELECT AVG(CAST(is_canceled AS DOUBLE)) AS prior FROM scored WHERE split = 'train'),
m AS (SELECT split, COUNT(*) AS n, SUM(is_canceled) AS p, AVG(POWER(risk_score - is_canceled, 2)) AS b1, AVG(POWER(pr.prior - is_canceled, 2)) AS b0
      FROM scored, pr GROUP BY split),
r AS (SELECT split, risk_score, is_canceled, RANK() OVER (PARTITION BY split ORDER BY risk_score) + (COUNT(*) OVER (PARTITION BY split, risk_score) - 1) / 2.0 AS rk FROM scored),
a AS (SELECT split, SUM(CASE WHEN is_canceled = 1 THEN rk ELSE 0 END) AS s FROM r GROUP BY split)
SELECT m.split, 'brier' AS metric, ROUND(b1, 6) AS model, ROUND(b0, 6) AS baseline, ROUND(b1 - b0, 6) AS delta FROM m
UNION ALL
SELECT m.split, 'roc_auc', ROUND((s - p * (p + 1) / 2.0) / (p * (n - p)), 6), 0.5, ROUND((s - p * (p + 1) / 2.0) / (p * (n - p)) - 0.5, 6) FROM m JOIN a ON a.split = m.split
""")
def q_metric_deltas(spark, sf):
    """M14 + M20: the rule score against the constant prior, metric by metric in long form"""
    s = inputs.scored(spark, sf)
    prior = s.where(F.col("split") == "train").agg(F.avg(F.col("is_canceled").cast("double")).alias("prior"))
    both = s.crossJoin(F.broadcast(prior)).select("booking_id", "split", "is_canceled", "risk_score", "prior")  # one row
    return EV.metric_deltas(both, "is_canceled", "risk_score", "prior", "booking_id", ["split"], ["brier", "roc_auc"]).select(
        "split", "metric", r6("model"), r6("baseline"), r6("delta"))


@register("cross_dataset")
def q_cross_dataset(spark, sf):
    """A model of the columns that both sources share, on the test rows of the first and on all of the second (two rows)"""
    from ..operators.features import prepare_features
    from .dataset_queries import prepared_second
    other = prepare_features(prepared_second(spark, sf), keep=("is_canceled",))
    _, rows = inputs.memo(spark, sf, "model-shared", lambda: M.cross_dataset_validation(inputs.prepared(spark, sf), other))
    return rows


@register("text_model_metrics")
def q_text_model_metrics(spark, sf):
    """TF-IDF of the booking text beside numeric and one-hot features, five regularisation settings (valid ROC-AUC each)"""
    from ..operators.text import booking_text
    p = inputs.prepared(spark, sf)
    texts = booking_text(inputs.raw(spark, sf)).select("booking_id", "booking_text")
    _, report = M.text_model(p.join(texts, "booking_id"))
    return spark.createDataFrame([(r["regParam"], r["valid_roc_auc"], r["dropped_terms"]) for r in report],
                                 "reg_param double, valid_roc_auc double, dropped_terms long")


@register("train_medians", """
SELECT 'lead_time' AS column, ROUND(quantile_cont(lead_time, 0.5), 6) AS median FROM prepared WHERE split = 'train'
UNION ALL SELECT 'adr', ROUND(quantile_cont(adr, 0.5), 6) FROM prepared WHERE split = 'train'
UNION ALL SELECT 'booking_value', ROUND(quantile_cont(booking_value, 0.5), 6) FROM prepared WHERE split = 'train'
""")
def q_train_medians(spark, sf):
    """M5: exact train medians of numeric features"""
    from ..operators.select import exact_quantiles
    p = inputs.prepared(spark, sf).where(F.col("split") == "train")
    long = p.selectExpr("booking_id", "stack(3, 'lead_time', lead_time, 'adr', adr, 'booking_value', booking_value) as (column, value)")
    return exact_quantiles(long, "value", [0.5], "booking_id", partition_by=["column"]).select("column", r6("q", "median"))


@register("train_categories", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {c} AS value, COUNT(*) AS n FROM prepared WHERE split = 'train' GROUP BY {c} HAVING COUNT(*) >= 10"
    for c in ("hotel", "meal", "country", "market_segment", "customer_type")))
def q_train_categories(spark, sf):
    """M6 + M8: categories that are frequent enough in train for a slot of their own"""
    p = inputs.prepared(spark, sf).where(F.col("split") == "train")
    cols = ["hotel", "meal", "country", "market_segment", "customer_type"]
    kept = M.fit_category_tables(p, cols).kept
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return p.selectExpr(f"stack({len(cols)}, {pairs}) as (column, value)").join(kept, ["column", "value"], "left_semi") \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@register("train_scales", """
SELECT 'lead_time' AS column, ROUND(stddev_samp(lead_time), 6) AS scale, TRUE AS only_numbers FROM prepared WHERE split = 'train'
UNION ALL SELECT 'adr', ROUND(stddev_samp(adr), 6), TRUE FROM prepared WHERE split = 'train'
""")
def q_train_scales(spark, sf):
    """M7: the fitted scaler's standard deviations; one-hot slots are not scaled"""
    from pyspark.ml import Pipeline
    p = inputs.prepared(spark, sf).where(F.col("split") == "train")
    stages = M.feature_stages(["lead_time", "adr"], ["hotel"])
    fitted = Pipeline(stages=stages).fit(p)
    std = [float(x) for x in fitted.stages[-2].std]
    return spark.createDataFrame([("lead_time", std[0], len(std) == 2), ("adr", std[1], len(std) == 2)], "column string, scale double, only_numbers boolean") \
        .select("column", r6("scale"), "only_numbers")


@register("platt_gradient", "SELECT COUNT(*) AS rows, TRUE AS mean_matches, TRUE AS slope_matches FROM prepared WHERE split = 'valid'")
def q_platt_gradient(spark, sf):
    """At the fitted calibration the gradient of the (lightly penalised) logistic loss is zero: mean and
    score-weighted mean of the calibrated probability meet those of the label"""
    v = inputs.scored(spark, sf).where(F.col("split") == "valid").select("booking_id", "is_canceled", F.col("risk_score").alias("raw_score"))
    cal = M.fit_platt(v)
    out = M.apply_calibration(v, cal)
    y = F.col("is_canceled").cast("double")
    slope = float(cal.coefficients[0])
    g = out.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("calibrated") - y).alias("a"), F.avg((F.col("calibrated") - y) * F.col("raw_score")).alias("b"))
    return g.select("rows", (F.abs("a") < 1e-5).alias("mean_matches"), (F.abs(F.col("b") + F.lit(slope) / F.col("rows")) < 1e-5).alias("slope_matches"))


@register("isotonic_blocks", "SELECT COUNT(*) AS rows, TRUE AS monotone, TRUE AS block_means FROM prepared WHERE split = 'valid'")
def q_isotonic_blocks(spark, sf):
    """The calibrated value never falls as the score rises, and each block's value is its mean label"""
    v = inputs.scored(spark, sf).where(F.col("split") == "valid").select("booking_id", "is_canceled", F.round("risk_score", 9).alias("raw_score"))
    out = M.apply_calibration(v, M.fit_isotonic(v)).checkpoint(eager=True)
    by_score = out.groupBy("raw_score").agg(F.min("calibrated").alias("lo"), F.max("calibrated").alias("hi"))
    pairs = by_score.alias("a").agg(F.array_sort(F.collect_list(F.struct("raw_score", "lo", "hi"))).alias("s"))  # distinct rule scores: a few dozen
    rising = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i)["lo"] >= F.get("s", i - 1)["hi"] - 1e-12)
    blocks = out.groupBy(F.round("calibrated", 9).alias("c")).agg(F.avg(F.col("is_canceled").cast("double")).alias("m"))
    close = blocks.agg((F.max(F.abs(F.col("c") - F.col("m"))) < 1e-6).alias("block_means"))
    return out.agg(F.count(F.lit(1)).alias("rows")).crossJoin(pairs.select(rising.alias("monotone"))).crossJoin(close)


@register("forest_scores")
def q_forest_scores(spark, sf):
    """The random forest candidate"""
    model = inputs.memo(spark, sf, "model-forest", lambda: M.train_model(
        inputs.prepared(spark, sf), candidates=[("Random forest", "random_forest", {"numTrees": 160, "maxDepth": 16})]))
    return M.predict(model, inputs.prepared(spark, sf)).select("booking_id", r6("risk_score"), r6("cancellation_probability"))


@register("logreg_metrics")
def q_logreg_metrics(spark, sf):
    """The balanced logistic regression with C = 1 over all train rows, its validation and test metrics (one row)"""
    m = inputs.memo(spark, sf, "model-logreg", lambda: M.train_model(
        inputs.prepared(spark, sf), candidates=[("Balanced logistic regression", "logreg", {"C": 1.0, "maxIter": 700})])).metrics
    c = m["candidate_metrics"][0]
    row = [(m["model"], m["rows_fit"], c["valid_roc_auc"], c["valid_pr_auc"], m["roc_auc"], m["pr_auc"], m["brier"])]
    return spark.createDataFrame(row, "model string, rows_fit long, valid_roc_auc double, valid_pr_auc double, roc_auc double, pr_auc double, brier double")


# ---------------------------------------------------------------------------
# file stream (R1 + R2)
# ---------------------------------------------------------------------------

@register("stream_scored", """
SELECT booking_id, risk_category, ROUND(expected_loss, 6) AS expected_loss FROM scored
""")
def q_stream_scored(spark, sf):
    """R1 + R2: the booking view as CSV files (one per creation month) scored by the file stream"""
    from ..session import ensure_checkpoint_dir
    from ..operators.store import batch_status, committed
    from ..streaming.files import start_file_scoring
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    inbox, root, ckpt = f"{base}/inbox", f"{base}/root", f"{base}/checkpoint"
    raw = inputs.raw(spark, sf)
    (raw.withColumn("month", F.date_format("booking_creation_date", "yyyy-MM"))
     .write.partitionBy("month").option("header", True).csv(inbox))  # every task writes its own files: no hot month
    q = start_file_scoring(spark, inbox, root, ckpt, available_now=True, recursive=True)
    q.awaitTermination()
    bad = batch_status(spark, root).where(F.col("status") != "completed").limit(1).count()
    if bad:
        raise RuntimeError("a stream batch did not complete")
    pred = committed(spark, root, "predictions")
    return pred.select(F.col("booking_id").cast("long").alias("booking_id"), "risk_category", r6("expected_loss"))
