"""Queries of the batch store (S4, S6-S10, J1, J4, A5, R2, P18): each writes batches of the booking view
to a new folder of the shared checkpoint folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as S
from ..operators.business import enrich_predictions, score_with_rules
from ..operators.features import prepare_features
from . import inputs
from .catalog import r6, register
from .dataset_queries import _scratch


def _persist(spark, root: str, raw, batch_id: str, name: str) -> None:
    """Score and persist one batch. Ids repeat in it (booking_id without its last digit), so only row ids can match."""
    raw = S.with_row_id(raw.withColumn("booking_id", F.floor(F.col("booking_id") / 10)))
    S.create_batch(spark, root, name, f"{name}.csv", "csv", batch_id)
    scored = enrich_predictions(score_with_rules(prepare_features(raw, keep=(S.ROW,))))
    S.persist_predictions(spark, root, raw, scored, "csv", batch_id)


def _two_batches(spark, sf, name: str) -> str:
    """Even and odd bookings as two batches; the first is written twice, as by a retry."""
    root = _scratch(spark, name)
    raw = inputs.raw(spark, sf).drop("split", "booking_creation_date")
    for batch, rest in (("b0", 0), ("b1", 1), ("b0", 0)):
        _persist(spark, root, raw.where(F.col("booking_id") % 2 == rest), batch, f"part {rest}")
    S.create_batch(spark, root, "later", "later.csv", "csv", "b2", queued=True)
    return root


_BATCH = "CASE WHEN booking_id % 2 = 0 THEN 'b0' ELSE 'b1' END"


@register("batch_roundtrip", """
SELECT CAST(CAST(FLOOR(booking_id / 10) AS BIGINT) AS VARCHAR) AS booking_id, lead_time, ROUND(expected_loss, 6) AS expected_loss, risk_category
FROM scored WHERE booking_id % 2 = 0 AND risk_category IN ('High', 'Critical', 'Medium', 'Low')
""")
def q_batch_roundtrip(spark, sf):
    """S6 + J1 + J4 + P18: a batch written twice, read back by category with its raw rows; ids repeat"""
    root = _two_batches(spark, sf, "roundtrip")
    parts = [S.get_predictions(spark, root, "b0", category=c) for c in ("High", "Critical", "Medium", "Low")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("booking_id", F.get_json_object("raw_json", "$.lead_time").cast("double").alias("lead_time"), r6("expected_loss"), "risk_category")


@register("batch_export", """
SELECT CAST(CAST(FLOOR(booking_id / 10) AS BIGINT) AS VARCHAR) AS booking_id, hotel, ROUND(expected_loss, 6) AS expected_loss, recommended_action
FROM scored WHERE booking_id % 2 = 1
""")
def q_batch_export(spark, sf):
    """S4 + S9: the export as a standard CSV parser reads it (factor lists hold quotes and commas)"""
    from ..sources.readers import read_csv_files
    root = _two_batches(spark, sf, "export")
    S.export_csv(spark, root, "b1", f"{root}/export")
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root}/export").select("path").collect()]
    out = read_csv_files(spark, files)
    return out.select("booking_id", "hotel", r6(F.col("expected_loss").cast("double"), "expected_loss"), "recommended_action")


@register("batch_overview", """
SELECT CAST(2 AS BIGINT) AS batches, COUNT(*) AS bookings, COUNT(*) FILTER (WHERE risk_category IN ('High', 'Critical')) AS high_risk_bookings,
  ROUND(SUM(expected_loss), 4) AS total_expected_loss FROM scored
""")
def q_batch_overview(spark, sf):
    """A5: totals over complete batches"""
    totals, _ = S.overview(spark, _two_batches(spark, sf, "overview"))
    return totals.select("batches", F.col("bookings").cast("long").alias("bookings"), F.col("high_risk_bookings").cast("long").alias("high_risk_bookings"),
                         F.round("total_expected_loss", 4).alias("total_expected_loss"))


@register("batch_ledger", f"""
, b AS (SELECT {_BATCH} AS batch_id, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE risk_category IN ('High', 'Critical')) AS high_risk_count,
        ROUND(SUM(booking_value), 4) AS total_booking_value FROM scored GROUP BY 1)
SELECT batch_id, CASE batch_id WHEN 'b0' THEN 'part 0' ELSE 'part 1' END AS name, CASE batch_id WHEN 'b0' THEN 'part 0.csv' ELSE 'part 1.csv' END AS file_name,
  'completed' AS status, row_count, high_risk_count, total_booking_value FROM b
UNION ALL SELECT 'b2', 'later', 'later.csv', 'queued', NULL, NULL, NULL
""")
def q_batch_ledger(spark, sf):
    """S7 + S8 + R2: batches in every state with name, file and numbers; one is looked up by id"""
    root = _two_batches(spark, sf, "ledger")
    rows = S.list_batches(spark, root).where(F.col("batch_id") != "b1").unionByName(S.get_batch(spark, root, "b1"))
    return rows.select("batch_id", "name", "file_name", "status", "row_count", "high_risk_count", F.round("total_booking_value", 4).alias("total_booking_value"))


@register("audit_log", """
SELECT event, n FROM (VALUES ('batch_created', CAST(4 AS BIGINT)), ('batch_scored', CAST(3 AS BIGINT))) AS t(event, n) WHERE (SELECT COUNT(*) FROM bookings) >= 0
""")
def q_audit_log(spark, sf):
    """One audit row per event"""
    root = _two_batches(spark, sf, "audit")
    return S.audit_log(spark, root).groupBy("event").agg(F.count(F.lit(1)).alias("n"))
