"""Persisted batches as Parquet tables.

Layout under one root folder (a shared filesystem path on a cluster):

* ``bookings/``    raw booking rows as JSON with their ``row_id``, one folder per ``batch_id``
* ``predictions/`` the prediction table with ``row_id``, ``top_factors`` as JSON text, one folder per batch
* ``batches/``     one header row per batch, written **last**: it is the commit marker, and
                   every reader goes through it, so a batch that died half-way is not seen
* ``ledger/``      append-only status rows (created, queued, scoring, completed, failed)
* ``audit/``       append-only audit events with a JSON payload; both logs are folded into snapshots (``logs``)

Each batch is written with dynamic partition overwrite: running it again replaces its own
folders and nothing else, so a retry never doubles rows. Rows of a batch are matched by
``row_id``, which the reader gives them before preparation; booking ids may repeat or be
missing.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import NUMERIC_PREDICTION_COLUMNS, PREDICTION_COLUMNS
from . import files, logs
from .business import batch_header
from .files import exists
from .filters import category_filter
from .ordered import with_row_index

ROW = "row_id"
STATUSES = ["created", "queued", "scoring", "completed", "failed"]
LEDGER = "batch_id string, name string, file_name string, source string, status string, files int, error string, updated_at timestamp"
HEADER = ("source string, row_count bigint, high_risk_count bigint, total_booking_value double, total_expected_loss double, "
          "created_at timestamp, batch_id string")
BOOKINGS = f"{ROW} bigint, raw_json string, batch_id string"
_NUMBERS = {*NUMERIC_PREDICTION_COLUMNS, "deposit_loss_factor"}
_TYPES = {c: "double" if c in _NUMBERS else "date" if c == "arrival_date" else "boolean" if c == "actionable" else "string" for c in PREDICTION_COLUMNS}
PREDICTIONS = ", ".join([f"{ROW} bigint", *(f"{c} {t}" for c, t in _TYPES.items()), "batch_id string"])
AUDIT = "audit_id string, event string, entity string, entity_id string, payload string, created_at timestamp"


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the store; empty before its first write."""
    path = f"{root}/{name}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _replace(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/{name}")


def write_audit(spark: SparkSession, root: str, event: str, entity: str, entity_id: str, payload: dict) -> None:
    """Append one audit row (payload as JSON text)."""
    row = [(str(uuid.uuid4()), event, entity, entity_id, json.dumps(payload, ensure_ascii=False, default=str), _now())]
    logs.append(spark.createDataFrame(row, AUDIT), root, "audit", AUDIT)


def set_status(spark: SparkSession, root: str, batch_id: str, status: str, name: str | None = None, file_name: str | None = None,
               source: str | None = None, files: int | None = None, error: str | None = None) -> None:
    """R2: append one status row; the error text is kept whole."""
    row = [(batch_id, name, file_name, source, status, files, error, _now())]
    logs.append(spark.createDataFrame(row, LEDGER), root, "ledger", LEDGER)


def create_batch(spark: SparkSession, root: str, name: str, file_name: str | None = None, source: str = "csv",
                 batch_id: str | None = None, queued: bool = False) -> str:
    """A batch that is known but not scored yet."""
    batch_id = batch_id or uuid.uuid4().hex
    set_status(spark, root, batch_id, "created", name, file_name, source)
    if queued:
        set_status(spark, root, batch_id, "queued")
    write_audit(spark, root, "batch_created", "scoring_batch", batch_id, {"name": name, "file_name": file_name, "source": source})
    return batch_id


def audit_log(spark: SparkSession, root: str) -> DataFrame:
    """All audit events."""
    return logs.read(spark, root, "audit", AUDIT)


def batch_status(spark: SparkSession, root: str) -> DataFrame:
    """R2: the latest state of every batch, with what its rows said about name, file and source."""
    led = logs.read(spark, root, "ledger", LEDGER)
    order = F.struct("updated_at", F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return led.groupBy("batch_id").agg(
        known("name"), known("file_name"), known("source"), F.max_by("status", order).alias("status"),
        F.max_by("error", order).alias("error"), F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def headers(spark: SparkSession, root: str) -> DataFrame:
    """Headers of the batches that are complete."""
    return _table(spark, root, "batches", HEADER)


def is_complete(spark: SparkSession, root: str, batch_id: str) -> bool:
    return exists(spark, f"{root}/batches/batch_id={batch_id}")


def with_row_id(raw: DataFrame) -> DataFrame:
    """The raw rows with the id that ties them to their predictions (J4); prepare with ``keep=(ROW,)``."""
    return raw if ROW in raw.columns else with_row_index(raw, ROW)


def persist_predictions(spark: SparkSession, root: str, raw: DataFrame, predictions: DataFrame, source: str,
                        batch_id: str | None = None) -> str:
    """S6 + S7: write bookings and predictions of one batch, then its header (commit marker).

    Both frames carry ``row_id``. The scored frame is reused by the write and the header, so it is
    checkpointed once to the session's checkpoint folder: a lost executor does not force
    re-scoring, and the outputs describe the same rows.
    """
    for name, frame in (("raw", raw), ("predictions", predictions)):
        if ROW not in frame.columns:
            raise ValueError(f"{name} has no {ROW}: give the raw rows one (with_row_id) and prepare them with keep=('{ROW}',)")
    batch_id = batch_id or create_batch(spark, root, source, source=source)
    scored = predictions.select(ROW, *PREDICTION_COLUMNS).checkpoint(eager=True)
    body = [F.col(f"`{c}`") for c in raw.columns if c != ROW]
    _replace(raw.select(F.col(ROW).cast("long").alias(ROW), F.to_json(F.struct(*body)).alias("raw_json"), F.lit(batch_id).alias("batch_id")), root, "bookings")
    stored = scored.withColumn("top_factors", F.to_json("top_factors")).select(
        F.col(ROW).cast("long").alias(ROW), *[F.col(c).cast(t).alias(c) for c, t in _TYPES.items()], F.lit(batch_id).alias("batch_id"))
    _replace(stored, root, "predictions")
    header = batch_header(scored).select(
        F.lit(source).alias("source"), "row_count", "high_risk_count", "total_booking_value", "total_expected_loss",
        F.lit(_now()).cast("timestamp").alias("created_at"), F.lit(batch_id).alias("batch_id"))
    _replace(header, root, "batches")
    set_status(spark, root, batch_id, "completed", source=source)
    write_audit(spark, root, "batch_scored", "scoring_batch", batch_id, {"source": source})
    return batch_id


def list_batches(spark: SparkSession, root: str, limit: int = 50) -> DataFrame:
    """Batches in any state, newest first, with the numbers of those that are complete."""
    done = headers(spark, root).drop("source", "created_at")
    return batch_status(spark, root).join(done, "batch_id", "left").orderBy(F.desc("created_at"), F.asc("batch_id")).limit(int(limit))


def get_batch(spark: SparkSession, root: str, batch_id: str) -> DataFrame:
    """One batch by id (no row if there is none)."""
    done = headers(spark, root).drop("source", "created_at")
    return batch_status(spark, root).where(F.col("batch_id") == batch_id).join(done, "batch_id", "left")


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of ``predictions`` or ``bookings`` whose batch is complete; batch ids are text, whatever they look like."""
    rows = _table(spark, root, name, {"predictions": PREDICTIONS, "bookings": BOOKINGS}[name])
    return rows.join(headers(spark, root).select("batch_id"), "batch_id", "left_semi")


def get_predictions(spark: SparkSession, root: str, batch_id: str, category: str | None = None,
                    limit: int | None = None) -> DataFrame:
    """J1 + P18 + O6: bookings joined with predictions of one batch, optional category, ranked."""
    pred = category_filter(committed(spark, root, "predictions").where(F.col("batch_id") == batch_id), category)
    book = committed(spark, root, "bookings").where(F.col("batch_id") == batch_id)
    out = pred.join(book, ["batch_id", ROW]).withColumn("top_factors", F.from_json("top_factors", "array<string>"))
    out = out.orderBy(F.desc_nulls_last("business_priority_score"), F.asc("booking_id"), F.asc(ROW))
    return out.limit(int(limit)) if limit else out


def export_csv(spark: SparkSession, root: str, batch_id: str, path: str, category: str | None = None) -> None:
    """S4 + S9: batch export as CSV with a header (arrays as JSON text, quotes doubled)."""
    df = get_predictions(spark, root, batch_id, category).drop("raw_json")
    write_csv(df.withColumn("top_factors", F.to_json("top_factors")), path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV as standard parsers read it: quotes inside a field are doubled, line ends are quoted."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def overview(spark: SparkSession, root: str, latest: int = 10) -> tuple[DataFrame, DataFrame]:
    """A5: totals across complete batches (the loss of all their predictions) and the latest batches."""
    done = headers(spark, root).agg(
        F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("bookings"),
        F.coalesce(F.sum("high_risk_count"), F.lit(0)).alias("high_risk_bookings"))
    loss = committed(spark, root, "predictions").agg(F.coalesce(F.sum("expected_loss"), F.lit(0.0)).alias("total_expected_loss"))
    return done.crossJoin(loss), list_batches(spark, root, latest)  # two one-row tables


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """One-row JSON metrics file."""
    spark.createDataFrame([(json.dumps(metrics, default=str),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def predictions_to_frame(df: DataFrame) -> DataFrame:
    """P25: numeric re-coercion (bad text -> 0); the probability falls back to the raw score."""
    out = df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
                          for c in NUMERIC_PREDICTION_COLUMNS if c in df.columns})
    if "cancellation_probability" not in df.columns and "risk_score" in df.columns:
        out = out.withColumn("cancellation_probability", F.col("risk_score"))
    return out


def row_digest(df: DataFrame):
    """md5 of a row: every column as text behind a mark that tells NULL from a value, and its length."""
    parts = []
    for c in df.columns:
        text = F.col(f"`{c}`").cast("string")
        parts.append(F.when(text.isNull(), "N").otherwise(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text)))
    return F.md5(F.concat(*parts).cast("binary"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count, sum and xor of 60 bits of the rows' md5."""
    h = F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))


DIGESTS = "path string, bytes bigint, changed bigint, rows bigint, hash_sum decimal(38,0), hash_xor bigint"


def fingerprint_files(spark: SparkSession, path: str, root: str) -> tuple[DataFrame, int]:
    """S13 of a Parquet table, file by file: the digest of the table as ``fingerprint`` gives it, and how many files were read for it.

    Sum and xor add up over files, so the digest of each file is kept in a log under ``root`` with its name,
    length and time of change, and only files that the log does not know are read.
    """
    there = files.data_files(spark, path)
    listed = spark.createDataFrame([(p, n, t) for p, (n, t) in there.items()], "path string, bytes bigint, changed bigint")
    on = ["path", "bytes", "changed"]
    known = logs.read(spark, root, "digests", DIGESTS).dropDuplicates(on)
    new = [r["path"] for r in listed.join(known, on, "left_anti").collect()]  # names of files
    if new:
        scheme = path[:path.index(":") + 1] if ":" in path.split("/")[0] else ""
        authority = path[len(scheme):].split("/")[2] if path[len(scheme):].startswith("//") else ""
        at = [f"{scheme}//{authority}{p}" if scheme else p for p in new]
        rows = spark.read.parquet(*at)
        h = F.conv(F.substring(row_digest(rows), 1, 15), 16, 10).cast("long")
        name = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:(//[^/]*)?", "")
        made = rows.select(name.alias("path"), h.alias("_h")).groupBy("path").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("_h").alias("hash_xor"))
        fresh = listed.where(F.col("path").isin(new)).join(made, "path", "left")  # a file without rows counts as one
        logs.append(fresh.select("path", "bytes", "changed", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), "hash_sum", "hash_xor"), root, "digests", DIGESTS)
        known = logs.read(spark, root, "digests", DIGESTS).dropDuplicates(on)
    total = listed.join(known, on).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"), F.sum("hash_sum").cast("decimal(38,0)").cast("string").alias("hash_sum"),
                                       F.bit_xor("hash_xor").alias("hash_xor"))
    return total, len(new)
