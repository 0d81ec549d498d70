from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stayguard.operators import encode as ENC
from stayguard.sources.bookings import split_label


def test_unknown_category_gets_prior(spark):
    cols = ["agent", "company_raw", "country", "market_segment", "distribution_channel", "deposit_type"]
    rows = [("1", "10", "PRT", "Online TA", "TA/TO", "No Deposit", 1), ("1", "10", "PRT", "Online TA", "TA/TO", "No Deposit", 1),
            ("2", None, "ESP", "Direct", "Direct", "Non Refund", 0), ("2", None, "ESP", "Direct", "Direct", "Non Refund", 0)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols) + ", is_canceled int")
    model = ENC.fit_target_encoder(train, "is_canceled", cols, smoothing=10.0)
    test = spark.createDataFrame([("1", "10", "PRT", "Online TA", "TA/TO", "No Deposit"),
                                  ("999", "77", "FRA", "Aviation", "GDS", "Refundable")], ", ".join(f"{c} string" for c in cols))
    out = ENC.transform_target_encoder(test, model).orderBy("agent").collect()
    seen, unseen = out[0], out[1]
    assert seen["agent_target_mean_smooth"] == pytest.approx((1.0 * 2 + 0.5 * 10) / 12)  # 0.58333
    assert seen["agent_freq_log"] == pytest.approx(1.0986122886681098)
    assert unseen["agent_target_mean_smooth"] == pytest.approx(0.5) and unseen["agent_freq_log"] == 0.0
    assert unseen["country_target_mean_smooth"] == pytest.approx(0.5)


def test_split_by_creation_date(spark):
    rows = [(dt.date(2016, 11, 10), 10), (dt.date(2017, 1, 15), 20), (dt.date(2017, 6, 20), 30)]
    df = spark.createDataFrame(rows, "arrival_date date, lead_time int")
    created = F.date_sub("arrival_date", F.col("lead_time"))
    out = [r["s"] for r in df.select(split_label(created, "2016-10-31", "2017-03-31").alias("s")).collect()]
    assert out == ["train", "valid", "test"]
