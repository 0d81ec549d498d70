"""Shared inputs of the query catalogue: raw, prepared and scored bookings.

The three views are logical plans (nothing is executed or cached here). They are
built once per session and table folder and then reused by every query: a
DataFrame is an immutable plan, so reuse only saves the Python-side plan
construction, and each query still reads the tables in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.business import enrich_predictions, score_with_rules
from ..operators.features import prepare_features
from ..session import ensure_checkpoint_dir
from ..sources.bookings import booking_view, table_stamp

CARRY = ("is_canceled", "split", "booking_creation_date")

TABLES = ("orders", "lineitem", "customer", "nation")

_PLANS: dict[tuple[int, str, str], tuple] = {}


def memo(spark: SparkSession, sf_dir: str, kind: str, build) -> DataFrame:
    key = (id(spark._jsparkSession), sf_dir.rstrip("/"), kind)
    stamp = tuple(table_stamp(spark, sf_dir, t) for t in TABLES)  # a plan holds the file listing of its tables
    if _PLANS.get(key, (None,))[0] != stamp:
        _PLANS[key] = (stamp, build())
    return _PLANS[key][1]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    # several operators cut lineage with checkpoint(): make sure the session names a
    # checkpoint folder (the cluster's setting is kept; a scratch one only when unset)
    ensure_checkpoint_dir(spark)
    return memo(spark, sf_dir, "raw", lambda: booking_view(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(spark, sf_dir, "prepared", lambda: prepare_features(raw(spark, sf_dir), keep=CARRY, ids_complete=True))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(spark, sf_dir, "scored", lambda: enrich_predictions(score_with_rules(prepared(spark, sf_dir))))
