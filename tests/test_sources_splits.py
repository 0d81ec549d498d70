from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from stayguard.operators.filters import check_row_limit, seeded_sample
from stayguard.operators.models import select_feature_columns
from stayguard.operators.rank import assign_split, chronological_split, fill_empty_splits, random_split
from stayguard.operators.store import write_metrics
from stayguard.plans import inputs
from stayguard.sources.readers import read_split, write_prepared


def test_existing_split_wins_then_cutoffs_then_chronological(spark):
    rows = [(1, dt.date(1999, 1, 1), dt.date(1999, 2, 1)), (2, dt.date(2000, 1, 1), dt.date(2000, 2, 1)),
            (3, dt.date(2001, 1, 1), dt.date(2001, 2, 1))]
    df = spark.createDataFrame(rows, "booking_id long, booking_creation_date date, arrival_date date")
    out, how = assign_split(df, train_cutoff="1999-06-30", valid_cutoff="2000-06-30")
    assert how == "booking_creation_date"
    assert [r["split"] for r in out.orderBy("booking_id").collect()] == ["train", "valid", "test"]
    given, how = assign_split(out)
    assert how == "existing_split_column"
    missing = df.withColumn("booking_creation_date", F.when(F.col("booking_id") == 2, None).otherwise(
        F.col("booking_creation_date")))
    fb, how = assign_split(missing)
    assert how == "arrival_date_fallback"
    assert fb.count() == 3


def test_random_split_is_reproducible(spark):
    df = spark.range(1, 2001).withColumnRenamed("id", "booking_id")
    a = {r["booking_id"]: r["split"] for r in random_split(df, 7).collect()}
    b = {r["booking_id"]: r["split"] for r in random_split(df.repartition(5), 7).collect()}
    assert a == b
    share = sum(1 for v in a.values() if v == "test") / len(a)
    assert 0.17 < share < 0.23
    valid = sum(1 for v in a.values() if v == "valid") / len(a)
    assert 0.13 < valid < 0.19


def test_split_of_raw_bookings_derives_the_creation_date(spark):
    """No creation date and no arrival date: both come from the parts; the real cutoffs are the defaults."""
    rows = [("1", "2016", "November", "10", "10"), ("2", "2017", "January", "15", "20"), ("3", "2017", "June", "20", "30")]
    df = spark.createDataFrame(rows, "booking_id string, arrival_date_year string, arrival_date_month string, "
                                     "arrival_date_day_of_month string, lead_time string")
    out, how = assign_split(df)
    assert how == "booking_creation_date"
    assert [r["split"] for r in out.orderBy("booking_id").collect()] == ["train", "valid", "test"]


def test_held_out_rows_never_move_to_train(spark):
    rows = [(str(i), "test" if i % 4 == 0 else "train") for i in range(400)]
    df = spark.createDataFrame(rows, "booking_id string, split string")
    out, moved = fill_empty_splits(df, {"train": 300, "valid": 0, "test": 100})
    got = {r["booking_id"]: r["split"] for r in out.collect()}
    assert moved and all((got[b] == "test") == (s == "test") for b, s in rows)
    assert 30 < sum(v == "valid" for v in got.values()) < 90
    assert fill_empty_splits(df, {"train": 200, "valid": 100, "test": 100})[1] is False


def test_rows_without_a_date_are_in_no_chronological_split(spark):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(20)] + [(99, None)]
    out = chronological_split(spark.createDataFrame(rows, "booking_id long, arrival_date date")).collect()
    assert len(out) == 20 and sum(r["chrono_split"] == "train" for r in out) == 14


def test_seeded_sample_independent_of_partitioning(spark):
    df = spark.range(1, 5001).withColumnRenamed("id", "booking_id")
    a = [r["booking_id"] for r in seeded_sample(df, 50, seed=3).collect()]
    b = [r["booking_id"] for r in seeded_sample(df.repartition(7), 50, seed=3).collect()]
    assert a == b and len(a) == 50


def test_row_limit(spark):
    df = spark.range(10)
    assert check_row_limit(df, 10) == 10
    with pytest.raises(ValueError):
        check_row_limit(df, 9)
    with pytest.raises(ValueError):
        check_row_limit(df.where("false"), 9)


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data missing")
def test_split_partitioned_table_and_metrics_file(spark):
    root = tempfile.mkdtemp(prefix="stayguard-prep-", dir="/tmp")
    p = inputs.prepared(spark, SMOKE)
    write_prepared(p, f"{root}/prepared")
    t = read_split(spark, f"{root}/prepared", "test")
    assert t.count() == p.where(F.col("split") == "test").count()
    write_metrics(spark, {"roc_auc": 0.5}, f"{root}/metrics")
    assert json.loads(spark.read.text(f"{root}/metrics").first()["value"])["roc_auc"] == 0.5
    num, cat = select_feature_columns(p, deny=("booking_id",))
    assert "lead_time" in num and "hotel" in cat and "is_canceled" not in num
