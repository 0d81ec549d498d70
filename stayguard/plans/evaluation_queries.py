"""Evaluation and encoding queries.

Scores: the rule score on the scored booking view; label: ``is_canceled``.
Metrics are computed per split (train / valid / test) over the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as ENC
from ..operators import evaluate as EV
from . import inputs
from .catalog import r6, register

SPLIT = ["split"]

ST_SQL = """
, st AS (SELECT {g}, risk_score, CAST(SUM(is_canceled) AS DOUBLE) AS pos, CAST(SUM(1 - is_canceled) AS DOUBLE) AS neg
         FROM scored GROUP BY {g}, risk_score)
"""


def _auc_sql(g: str) -> str:
    return ST_SQL.format(g=g) + f"""
, c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY {g} ORDER BY risk_score
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM st)
SELECT {g}, ROUND(CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
  THEN SUM(pos * (below + 0.5 * neg)) / (SUM(pos) * SUM(neg)) END, 6) AS roc_auc FROM c GROUP BY {g}
"""


def _curve_sql(g: str) -> str:
    return ST_SQL.format(g=g) + f"""
, c AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, ROW_NUMBER() OVER w AS threshold_rank,
               SUM(pos) OVER (PARTITION BY {g}) AS P, SUM(neg) OVER (PARTITION BY {g}) AS N
        FROM st WINDOW w AS (PARTITION BY {g} ORDER BY risk_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@register("roc_auc", _auc_sql("split"))
def q_roc_auc(spark, sf):
    """W9"""
    return EV.roc_auc(inputs.scored(spark, sf), "is_canceled", "risk_score", SPLIT).select("split", r6("roc_auc"))


@register("avg_precision", _curve_sql("split") + """
SELECT split, ROUND(CASE WHEN MAX(P) > 0 THEN SUM(pos / P * (tp / (tp + fp))) END, 6) AS pr_auc FROM c GROUP BY split
""")
def q_avg_precision(spark, sf):
    """W10"""
    return EV.average_precision(inputs.scored(spark, sf), "is_canceled", "risk_score", SPLIT).select(
        "split", r6("pr_auc"))


@register("roc_points", _curve_sql("split") + """
SELECT split, ROUND(risk_score, 6) AS threshold, threshold_rank, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  ROUND(tp / P, 6) AS tpr, ROUND(fp / N, 6) AS fpr, ROUND(tp / (tp + fp), 6) AS precision FROM c
""")
def q_roc_points(spark, sf):
    """W11"""
    c = EV.curve(inputs.scored(spark, sf), "is_canceled", "risk_score", SPLIT)
    return c.select("split", r6("threshold"), "threshold_rank", "tp", "fp", r6("tpr"), r6("fpr"), r6("precision"))


@register("brier", """
SELECT split, ROUND(AVG(POWER(risk_score - is_canceled, 2)), 6) AS brier FROM scored GROUP BY split
""")
def q_brier(spark, sf):
    """W12"""
    return EV.brier(inputs.scored(spark, sf), "is_canceled", "risk_score", SPLIT).select("split", r6("brier"))


def _topk_sql(g: str, frac: float, pct: int, rounding: str = "FLOOR", eps: str = "1e-9") -> str:
    return f"""
, r AS (SELECT {g}, is_canceled, ROW_NUMBER() OVER (PARTITION BY {g} ORDER BY risk_score DESC, booking_id) AS rk,
               COUNT(*) OVER (PARTITION BY {g}) AS n, SUM(is_canceled) OVER (PARTITION BY {g}) AS pos FROM scored),
k AS (SELECT *, GREATEST(1, CAST({rounding}(n * {frac}::DOUBLE) AS BIGINT)) AS k FROM r)
SELECT {g}, ROUND(SUM(is_canceled)::DOUBLE / MAX(k), 6) AS precision_at_{pct},
  ROUND(SUM(is_canceled)::DOUBLE / GREATEST(MAX(pos), 1), 6) AS recall_at_{pct},
  ROUND((SUM(is_canceled)::DOUBLE / MAX(k)) / GREATEST(MAX(pos)::DOUBLE / MAX(n), {eps}), 6) AS lift_at_{pct}
FROM k WHERE rk <= k GROUP BY {g}
"""


@register("topk_metrics", _topk_sql("split", 0.2, 20))
def q_topk_metrics(spark, sf):
    """W8 (service variant: k = max(1, floor(0.2 n)))"""
    t = EV.topk(inputs.scored(spark, sf), "is_canceled", "risk_score", "booking_id", 0.2, "floor", SPLIT)
    return t.select("split", r6("precision_at_20"), r6("recall_at_20"), r6("lift_at_20"))


@register("topk_metrics_ceil10", _topk_sql("split", 0.1, 10, "CEIL", "1e-12"))
def q_topk_ceil10(spark, sf):
    """W8 (notebook variant: k = max(1, ceil(0.1 n)))"""
    t = EV.topk(inputs.scored(spark, sf), "is_canceled", "risk_score", "booking_id", 0.1, "ceil", SPLIT)
    return t.select("split", r6("precision_at_10"), r6("recall_at_10"), r6("lift_at_10"))


CONF_SQL = """
, cnt AS (SELECT split,
    COUNT(*) FILTER (WHERE is_canceled = 1 AND risk_score >= 0.5) AS tp,
    COUNT(*) FILTER (WHERE is_canceled = 0 AND risk_score >= 0.5) AS fp,
    COUNT(*) FILTER (WHERE is_canceled = 0 AND risk_score < 0.5) AS tn,
    COUNT(*) FILTER (WHERE is_canceled = 1 AND risk_score < 0.5) AS fn FROM scored GROUP BY split),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM cnt)
SELECT split, tp, fp, tn, fn, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall,
  ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
  ROUND(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS f2
FROM pr
"""


@register("confusion", CONF_SQL)
def q_confusion(spark, sf):
    """A30"""
    c = EV.confusion(inputs.scored(spark, sf), "is_canceled", "risk_score", 0.5, SPLIT)
    return c.select("split", "tp", "fp", "tn", "fn", r6("precision"), r6("recall"), r6("f1"), r6("f2"))


def _grid_list() -> str:
    return "[" + ", ".join(repr(p) for p in EV.GRID_PROBS) + "]"


F2_SQL = f"""
, q AS (SELECT quantile_cont(risk_score, {_grid_list()}) AS qs FROM scored),
g AS (SELECT CAST(i - 1 AS INT) AS grid_index, qs[i] AS t FROM q, range(1, 62) r(i)),
m AS (SELECT g.grid_index, g.t,
        COUNT(*) FILTER (WHERE s.risk_score >= g.t AND s.is_canceled = 1) AS tp,
        COUNT(*) FILTER (WHERE s.risk_score >= g.t AND s.is_canceled = 0) AS fp
      FROM g CROSS JOIN scored s GROUP BY 1, 2),
pp AS (SELECT SUM(is_canceled) AS P FROM scored),
f AS (SELECT m.*, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec,
             CASE WHEN tp + (pp.P - tp) > 0 THEN tp / (tp + (pp.P - tp)) ELSE 0.0 END AS rec FROM m, pp),
f2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 5 * prec * rec / (4 * prec + rec) ELSE 0.0 END AS f2 FROM f)
"""


@register("f2_threshold", F2_SQL + """
SELECT ROUND(t, 6) AS threshold, ROUND(f2, 6) AS f2, grid_index FROM f2 ORDER BY f2 DESC, grid_index LIMIT 1
""")
def q_f2_threshold(spark, sf):
    """M18 + N14 + J8"""
    b = EV.f2_threshold(inputs.scored(spark, sf), "is_canceled", "risk_score", "booking_id")
    return b.select(r6("threshold"), r6("f2"), "grid_index")


@register("threshold_grid", """
, q AS (SELECT quantile_cont(risk_score, """ + _grid_list() + """) AS qs FROM scored)
SELECT CAST(i - 1 AS INT) AS grid_index, ROUND(qs[i], 6) AS t FROM q, range(1, 62) r(i)
""")
def q_threshold_grid(spark, sf):
    """61 exact score quantiles, 5 %..95 %"""
    g = EV.threshold_grid(inputs.scored(spark, sf), "risk_score", "booking_id")
    return g.select("grid_index", r6("t"))


SEGMENTS = ["hotel", "deposit_type", "market_segment", "customer_type"]


def _segment_sql() -> str:
    parts = []
    for s in SEGMENTS:
        parts.append(f"""
SELECT '{s}' AS segment, CAST(b.{s} AS VARCHAR) AS value, b.rows, ROUND(b.cancel_rate, 6) AS cancel_rate,
  ROUND(a.roc_auc, 6) AS roc_auc, ROUND(p.pr_auc, 6) AS pr_auc, ROUND(t.precision_at_20, 6) AS precision_at_20,
  ROUND(t.recall_at_20, 6) AS recall_at_20, ROUND(t.lift_at_20, 6) AS lift_at_20,
  ROUND(b.expected_loss_sum, 6) AS expected_loss_sum
FROM (SELECT {s}, COUNT(*) AS rows, AVG(CAST(is_canceled AS DOUBLE)) AS cancel_rate, SUM(expected_loss) AS expected_loss_sum
      FROM scored GROUP BY {s}) b
JOIN (SELECT {s}, SUM(pos * (below + 0.5 * neg)) / NULLIF(SUM(pos) * SUM(neg), 0) AS roc_auc
      FROM (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY {s} ORDER BY risk_score
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
            FROM (SELECT {s}, risk_score, CAST(SUM(is_canceled) AS DOUBLE) AS pos, CAST(SUM(1 - is_canceled) AS DOUBLE) AS neg
                  FROM scored GROUP BY {s}, risk_score)) GROUP BY {s}) a USING ({s})
JOIN (SELECT {s}, CASE WHEN MAX(P) > 0 THEN SUM(pos / P * (tp / (tp + fp))) END AS pr_auc
      FROM (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY {s}) AS P
            FROM (SELECT {s}, risk_score, CAST(SUM(is_canceled) AS DOUBLE) AS pos, CAST(SUM(1 - is_canceled) AS DOUBLE) AS neg
                  FROM scored GROUP BY {s}, risk_score)
            WINDOW w AS (PARTITION BY {s} ORDER BY risk_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      GROUP BY {s}) p USING ({s})
JOIN (SELECT {s}, SUM(is_canceled)::DOUBLE / MAX(k) AS precision_at_20,
             SUM(is_canceled)::DOUBLE / GREATEST(MAX(pos), 1) AS recall_at_20,
             (SUM(is_canceled)::DOUBLE / MAX(k)) / GREATEST(MAX(pos)::DOUBLE / MAX(n), 1e-12) AS lift_at_20
      FROM (SELECT *, GREATEST(1, CAST(CEIL(n * 0.2::DOUBLE) AS BIGINT)) AS k
            FROM (SELECT {s}, is_canceled, ROW_NUMBER() OVER (PARTITION BY {s} ORDER BY risk_score DESC, booking_id) AS rk,
                         COUNT(*) OVER (PARTITION BY {s}) AS n, SUM(is_canceled) OVER (PARTITION BY {s}) AS pos FROM scored))
      WHERE rk <= k GROUP BY {s}) t USING ({s})
WHERE b.rows >= 50""")
    return "\nUNION ALL\n".join(parts)


@register("segment_quality", _segment_sql())
def q_segment_quality(spark, sf):
    """Per-segment quality for four segment columns, groups under 50 rows dropped"""
    s = inputs.scored(spark, sf)
    out = EV.segment_quality(s, SEGMENTS, "is_canceled", "risk_score", "booking_id", "expected_loss")
    return out.select("segment", "value", "rows", r6("cancel_rate"), r6("roc_auc"), r6("pr_auc"),
                      r6("precision_at_20"), r6("recall_at_20"), r6("lift_at_20"), r6("expected_loss_sum"))


_EVALUATION_SQL = """
, st AS (SELECT risk_score, CAST(SUM(is_canceled) AS DOUBLE) AS pos, CAST(SUM(1 - is_canceled) AS DOUBLE) AS neg
         FROM scored GROUP BY risk_score),
auc AS (SELECT SUM(pos * (below + 0.5 * neg)) / (SUM(pos) * SUM(neg)) AS roc_auc
        FROM (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY risk_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM st)),
ap AS (SELECT SUM(pos / P * (tp / (tp + fp))) AS pr_auc
       FROM (SELECT *, SUM(pos) OVER (ORDER BY risk_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                    SUM(neg) OVER (ORDER BY risk_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                    SUM(pos) OVER () AS P FROM st)),
br AS (SELECT AVG(POWER(risk_score - is_canceled, 2)) AS brier FROM scored),
cf AS (SELECT COUNT(*) FILTER (WHERE is_canceled = 1 AND risk_score >= 0.5) AS tp,
              COUNT(*) FILTER (WHERE is_canceled = 0 AND risk_score >= 0.5) AS fp,
              COUNT(*) FILTER (WHERE is_canceled = 1 AND risk_score < 0.5) AS fn FROM scored),
pr AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM cf),
rk AS (SELECT is_canceled, ROW_NUMBER() OVER (ORDER BY risk_score DESC, booking_id) AS rk, COUNT(*) OVER () AS n,
              SUM(is_canceled) OVER () AS pos FROM scored),
t10 AS (SELECT SUM(is_canceled)::DOUBLE / MAX(k) AS p10, SUM(is_canceled)::DOUBLE / GREATEST(MAX(pos), 1) AS r10,
               (SUM(is_canceled)::DOUBLE / MAX(k)) / GREATEST(MAX(pos)::DOUBLE / MAX(n), 1e-12) AS l10
        FROM (SELECT *, GREATEST(1, CAST(CEIL(n * 0.1::DOUBLE) AS BIGINT)) AS k FROM rk) WHERE rk <= k),
t20 AS (SELECT SUM(is_canceled)::DOUBLE / MAX(k) AS p20, SUM(is_canceled)::DOUBLE / GREATEST(MAX(pos), 1) AS r20,
               (SUM(is_canceled)::DOUBLE / MAX(k)) / GREATEST(MAX(pos)::DOUBLE / MAX(n), 1e-12) AS l20
        FROM (SELECT *, GREATEST(1, CAST(CEIL(n * 0.2::DOUBLE) AS BIGINT)) AS k FROM rk) WHERE rk <= k)
SELECT ROUND(roc_auc, 6) AS roc_auc, ROUND(pr_auc, 6) AS pr_auc, ROUND(brier, 6) AS brier,
  ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
  ROUND(p10, 6) AS precision_at_10, ROUND(r10, 6) AS recall_at_10, ROUND(l10, 6) AS lift_at_10,
  ROUND(p20, 6) AS precision_at_20, ROUND(r20, 6) AS recall_at_20, ROUND(l20, 6) AS lift_at_20, 0.5 AS threshold,
  ROUND(0.35 * roc_auc + 0.25 * pr_auc + 0.20 * LEAST(l20 / 3, 1) + 0.10 * r20 + 0.10 * (1 - brier), 6) AS quality_index
FROM auc, ap, br, pr, t10, t20
"""


@register("evaluation_row", _EVALUATION_SQL)
def q_evaluation_row(spark, sf):
    """M19 + N16: one row of metrics for the rule score over the whole table"""
    row = EV.quality_index(EV.evaluation_row(inputs.scored(spark, sf), "is_canceled", "risk_score", "booking_id"))
    cols = ["roc_auc", "pr_auc", "brier", "precision", "recall", "f1", "precision_at_10", "recall_at_10", "lift_at_10",
            "precision_at_20", "recall_at_20", "lift_at_20"]
    return row.select(*[r6(c) for c in cols], F.col("threshold").cast("double").alias("threshold"), r6("quality_index"))


def _run_sql() -> str:
    """The evaluation of one split, in long form."""
    def of(split: str) -> str:
        body = _EVALUATION_SQL.replace("FROM scored", f"FROM (SELECT * FROM scored WHERE split = '{split}')")
        return f"SELECT * FROM (WITH {body.strip().removeprefix(',')}) UNPIVOT (v FOR metric IN (COLUMNS(*)))"
    return f"""
SELECT 'run-2' AS run_id, 'rule score' AS model, metric, 'run-1' AS previous_run, b.v AS previous, a.v AS current, ROUND(a.v - b.v, 6) AS delta
FROM ({of('test')}) a JOIN ({of('valid')}) b USING (metric)"""


@register("run_deltas", _run_sql())
def q_run_deltas(spark, sf):
    """The evaluation of a run (test) beside the stored run of the same model before it (valid), all metrics of M19"""
    import datetime as dt
    from ..operators.runs import record_run, run_deltas
    from .dataset_queries import _scratch
    root = _scratch(spark, "runs")
    at = [f"{name}_at_{pct}" for pct in (10, 20) for name in ("precision", "recall", "lift")]
    metrics = ["roc_auc", "pr_auc", "brier", "precision", "recall", "f1", *at]
    rows = EV.quality_index(EV.score_metrics(inputs.scored(spark, sf), "is_canceled", "risk_score", "booking_id", [0.10, 0.20], "ceil", SPLIT)).checkpoint(eager=True)
    for k, (run, split, model) in enumerate([("run-0", "train", "other"), ("run-1", "train", "rule score"), ("run-1", "valid", "rule score"), ("run-2", "test", "rule score")]):
        row = rows.where(F.col("split") == split).select(*[r6(c) for c in metrics], F.lit(0.5).alias("threshold"), r6("quality_index"))
        record_run(row, root, run, model, dt.datetime(2024, 1, 1 + k))
    return run_deltas(spark, root, "run-2").withColumn("delta", F.round("delta", 6))


# ---------------------------------------------------------------------------
# encoders (fit on train, applied to every row)
# ---------------------------------------------------------------------------

ENC_COLS = ["agent", "company_raw", "country", "market_segment", "distribution_channel", "deposit_type"]


def _enc_sql() -> str:
    stats = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col, {c} AS key, COUNT(*) AS n, AVG(CAST(is_canceled AS DOUBLE)) AS mean FROM prepared "
        f"WHERE split = 'train' GROUP BY {c}" for c in ENC_COLS)
    sel = []
    joins = []
    for c in ENC_COLS:
        p = "company" if c == "company_raw" else c
        joins.append(f"LEFT JOIN st AS s_{c} ON s_{c}.col = '{c}' AND s_{c}.key = p.{c}")
        sel.append(f"ROUND(COALESCE((s_{c}.mean * s_{c}.n + pr.prior * 60.0) / (s_{c}.n + 60.0), pr.prior), 6) "
                   f"AS {p}_target_mean_smooth")
        if c in ("agent", "company_raw"):
            sel.append(f"ROUND(ln(1 + COALESCE(CAST(s_{c}.n AS DOUBLE), 0.0)), 6) AS {p}_freq_log")
    return f"""
, pr AS (SELECT COALESCE(AVG(CAST(is_canceled AS DOUBLE)), 0.35) AS prior FROM prepared WHERE split = 'train'),
st AS ({stats})
SELECT p.booking_id, {", ".join(sel)}
FROM prepared p CROSS JOIN pr {" ".join(joins)}
"""


@register("target_encode", _enc_sql())
def q_target_encode(spark, sf):
    """A28 + J2 + M3: train-only smoothed target means and frequencies, applied to all rows"""
    p = inputs.prepared(spark, sf)
    p = p.drop(*[c for c in p.columns if c.endswith("_target_mean_smooth") or c.endswith("_freq_log")])
    model = ENC.fit_target_encoder(p.where(F.col("split") == "train"), "is_canceled", ENC_COLS)
    out = ENC.transform_target_encoder(p, model)
    outs = []
    for c in ENC_COLS:
        pfx = "company" if c == "company_raw" else c
        outs.append(r6(f"{pfx}_target_mean_smooth"))
        if c in ("agent", "company_raw"):
            outs.append(r6(f"{pfx}_freq_log"))
    return out.select("booking_id", *outs)


def _wide_sql() -> str:
    cols, means = ENC.WIDE_FREQUENCIES, ENC.WIDE_MEANS
    m = ENC.WIDE_SMOOTHING
    stats = ", ".join(f"s_{c} AS (SELECT {c} AS k, COUNT(*) AS n, AVG(CAST(is_canceled AS DOUBLE)) AS mean FROM prepared WHERE split = 'train' GROUP BY {c})" for c in cols)
    name = lambda c: "company" if c == "company_raw" else c
    out = ", ".join([f"ROUND(ln(1 + COALESCE(s_{c}.n, 0)), 6) AS {name(c)}_freq_log" for c in cols]
                    + [f"ROUND(COALESCE((s_{c}.mean * s_{c}.n + prior * {m}) / (s_{c}.n + {m}), prior), 6) AS {name(c)}_target_mean_smooth" for c in means])
    joins = " ".join(f"LEFT JOIN s_{c} ON s_{c}.k = p.{c}" for c in cols)
    return f""", pr AS (SELECT AVG(CAST(is_canceled AS DOUBLE)) AS prior FROM prepared WHERE split = 'train'), {stats}
SELECT p.booking_id, {out} FROM prepared p CROSS JOIN pr {joins}"""


@register("wide_encoding", _wide_sql())
def q_wide_encoding(spark, sf):
    """M4: nine log frequencies and six target means (100 rows of smoothing), counted on train, written to all rows"""
    p = inputs.prepared(spark, sf)
    out = ENC.wide_encoding(p.drop(*[c for c in p.columns if c.endswith("_target_mean_smooth") or c.endswith("_freq_log")]), p.where(F.col("split") == "train"))
    made = [c for c in out.columns if c.endswith("_freq_log") or c.endswith("_target_mean_smooth")]
    return out.select("booking_id", *[r6(c) for c in made])


FREQ_COLS = ["agent", "company_raw", "country", "market_segment", "distribution_channel", "deposit_type", "meal",
             "reserved_room_type", "customer_type"]


@register("freq_encode", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {c} AS key, COUNT(*) AS n, ROUND(ln(1 + COUNT(*)), 6) AS freq_log FROM prepared "
    f"WHERE split = 'train' GROUP BY {c}" for c in FREQ_COLS))
def q_freq_encode(spark, sf):
    """A29 + M4: nine-column frequency table on the train split"""
    p = inputs.prepared(spark, sf).where(F.col("split") == "train")
    return ENC.frequency_table(p, FREQ_COLS).select("column", "key", "n", r6("freq_log"))


CLIP_COLS = ["lead_time", "adr", "booking_value"]
ALL_CLIP_COLS = CLIP_COLS + [
    "stays_in_weekend_nights", "stays_in_week_nights", "total_nights", "adults", "children", "babies", "total_guests", "previous_cancellations",
    "previous_bookings_not_canceled", "required_car_parking_spaces", "total_of_special_requests", "arrival_date_year", "arrival_month_num",
    "arrival_date_week_number", "arrival_date_day_of_month"]


def _clip_sql(columns: list[str]) -> str:
    edges = ", ".join(f"quantile_cont({c}, 0.001) AS {c}_lo, quantile_cont({c}, 0.999) AS {c}_hi" for c in columns)
    clipped = ", ".join(f"ROUND(LEAST(GREATEST({c}, {c}_lo), {c}_hi), 6) AS {c}" for c in columns)
    return f", e AS (SELECT {edges} FROM prepared WHERE split = 'train') SELECT booking_id, {clipped} FROM prepared CROSS JOIN e"


def _clip(columns: list[str]):
    def q(spark, sf):
        """Clip with train-only 0.1 % / 99.9 % edges"""
        p = inputs.prepared(spark, sf)
        edges = ENC.fit_quantile_clip(p.where(F.col("split") == "train"), columns, "booking_id")
        return ENC.apply_quantile_clip(p, edges, columns).select("booking_id", *[r6(c) for c in columns])
    return q


register("quantile_clip", _clip_sql(CLIP_COLS))(_clip(CLIP_COLS))
register("quantile_clip_all", _clip_sql(ALL_CLIP_COLS))(_clip(ALL_CLIP_COLS))


FINGERPRINT_COLS = ["booking_id", "hotel", "lead_time", "country", "market_segment", "agent", "company_raw", "deposit_type"]


_FINGERPRINT_SQL = (", r AS (SELECT CAST('0x' || substr(md5(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN 'N' ELSE 'V' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in FINGERPRINT_COLS) + """), 1, 15) AS BIGINT) AS h
  FROM bookings)
SELECT COUNT(*) AS rows, CAST(SUM(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM r
""")


@register("fingerprint", _FINGERPRINT_SQL)
def q_fingerprint(spark, sf):
    """Order-free digest of the booking view (columns whose text is alike in both engines)"""
    from ..operators.store import fingerprint
    return fingerprint(inputs.raw(spark, sf).select(*FINGERPRINT_COLS))


@register("fingerprint_files", _FINGERPRINT_SQL)
def q_fingerprint_files(spark, sf):
    """The same digest added up from the digests of files, of which the second call reads the appended ones only"""
    from ..operators.store import fingerprint_files
    from .dataset_queries import _scratch
    root = _scratch(spark, "digests")
    rows = inputs.raw(spark, sf).select(*FINGERPRINT_COLS)
    for rest in (0, 1):
        rows.where(F.col("booking_id") % 2 == rest).write.mode("append").parquet(f"{root}/table")
        total, _ = fingerprint_files(spark, f"{root}/table", f"{root}/store")
    return total


@register("target_encode_customer", """
, c AS (SELECT p.booking_id, p.split, p.is_canceled, CAST(o.o_custkey AS VARCHAR) AS agent FROM prepared p JOIN orders o ON o.o_orderkey = p.booking_id),
pr AS (SELECT AVG(CAST(is_canceled AS DOUBLE)) AS prior FROM c WHERE split = 'train'),
st AS (SELECT agent, COUNT(*) AS n, AVG(CAST(is_canceled AS DOUBLE)) AS m FROM c WHERE split = 'train' GROUP BY agent)
SELECT c.booking_id, ROUND(COALESCE((st.m * st.n + pr.prior * 100) / (st.n + 100), pr.prior), 6) AS agent_target_mean_smooth,
  ROUND(ln(1 + COALESCE(st.n, 0)), 6) AS agent_freq_log
FROM c CROSS JOIN pr LEFT JOIN st ON st.agent = c.agent
""")
def q_target_encode_customer(spark, sf):
    """J2 + A28 + M4: encoding of a key with many values (the customer), smoothing 100"""
    from ..sources.bookings import read_table
    keys = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("booking_id"), F.col("o_custkey").cast("string").alias("agent"))
    p = inputs.prepared(spark, sf).select("booking_id", "split", "is_canceled").join(keys, "booking_id")
    model = ENC.fit_target_encoder(p.where(F.col("split") == "train"), "is_canceled", ["agent"], smoothing=100.0)
    out = ENC.transform_target_encoder(p, model)
    return out.select("booking_id", r6("agent_target_mean_smooth"), r6("agent_freq_log"))

