"""Metrics of evaluation runs, kept by run and metric, and their change from run to run."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

RUNS = "model string, metric string, value double, recorded_at timestamp, run_id string"


def record_run(metrics: DataFrame, root: str, run_id: str, model: str, recorded_at: _dt.datetime | None = None) -> None:
    """Store a one-row table of metrics as (metric, value) rows; recording a run again replaces it."""
    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in metrics.columns)
    rows = metrics.selectExpr(f"stack({len(metrics.columns)}, {names}) as (metric, value)")
    when = recorded_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = rows.select(F.lit(model).alias("model"), "metric", "value", F.lit(when).cast("timestamp").alias("recorded_at"), F.lit(run_id).alias("run_id"))
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/runs")


def runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{root}/runs") if files.exists(spark, f"{root}/runs") else spark.createDataFrame([], RUNS)


def run_deltas(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Every metric of a run beside that of the last run of the same model before it; NULL where there was none."""
    table = runs(spark, root)
    current = table.where(F.col("run_id") == run_id)
    before = current.select("model", F.col("recorded_at").alias("_at")).distinct()
    earlier = table.join(F.broadcast(before), "model").where((F.col("recorded_at") < F.col("_at")) & (F.col("run_id") != run_id))  # one row: the run's model
    last = earlier.groupBy("model", "metric").agg(F.max_by(F.struct("run_id", "value"), F.struct("recorded_at", "run_id")).alias("_p"))
    out = current.select("run_id", "model", "metric", F.col("value").alias("current")).join(last, ["model", "metric"], "left")
    return out.select("run_id", "model", "metric", F.col("_p.run_id").alias("previous_run"), F.col("_p.value").alias("previous"), "current",
                      (F.col("current") - F.col("_p.value")).alias("delta"))
