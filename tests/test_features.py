from __future__ import annotations

import datetime as dt

import pytest

from conftest import BOOKING, frame
from stayguard.operators.features import prepare_features
from stayguard.operators.schema import resolve_columns, validate_input


def row(df):
    return df.collect()[0].asDict()


def test_prepared_values_of_one_booking(one_booking):
    r = row(prepare_features(one_booking))
    assert r["total_nights"] == 3 and r["total_guests"] == 2 and r["booking_value"] == 360.0
    assert r["has_previous_cancellations"] == 1 and r["is_long_lead_booking"] == 1
    assert r["arrival_date"] == dt.date(2017, 8, 10)
    assert r["arrival_season"] == "summer" and r["arrival_quarter"] == 3
    assert r["arrival_dayofweek"] == 3  # Thursday, Monday = 0
    assert r["country_missing"] == 0 and r["agent"] == "Unknown" and r["agent_missing"] == 1
    assert r["has_company"] == 0
    assert r["no_special_no_parking"] == 1 and r["is_single_adult"] == 0


def test_leakage_columns_are_dropped(spark):
    df = frame(spark, [dict(BOOKING, reservation_status="Canceled", booking_changes="3")])
    out = prepare_features(df, keep=("reservation_status", "booking_changes"))
    assert "reservation_status" not in out.columns and "booking_changes" not in out.columns


def test_invalid_numbers_are_clipped(spark):
    df = frame(spark, [dict(BOOKING, lead_time=-10, adr=-50, stays_in_weekend_nights=-1, stays_in_week_nights=-2,
                            adults=0)])
    r = row(prepare_features(df))
    assert r["lead_time"] == 0 and r["adr"] == 0
    assert r["total_nights"] == 1 and r["total_guests"] == 1
    assert r["booking_value"] == 0


def test_bad_text_nan_and_infinity_become_zero(spark):
    df = frame(spark, [dict(BOOKING, adr="abc"), dict(BOOKING, booking_id="B-3", adr="inf"),
                       dict(BOOKING, booking_id="B-4", adr="nan")])
    vals = {r["booking_id"]: (r["adr"], r["booking_value"]) for r in prepare_features(df).collect()}
    assert vals["B-1"] == (0.0, 0.0)
    assert vals["B-3"] == (0.0, 0.0)  # +inf survives the floor, the sanitiser folds it to 0
    assert vals["B-4"] == (0.0, 0.0)


def test_strict_mode_rejects_missing_required(spark):
    df = frame(spark, [{"booking_id": "X", "hotel": "City Hotel"}])
    with pytest.raises(ValueError):
        prepare_features(df, strict=True)


def test_tolerant_mapping_of_aliases_and_date_outside_august(spark):
    df = frame(spark, [{"LeadTime": "12", "avg_price_per_room": "99.5", "no_of_week_nights": "3", "no_of_adults": "2",
                        "arrival_date": "2016-03-05", "type_of_meal_plan": "HB", "unknown_col": "x"}])
    m = resolve_columns(df)
    assert m.mapped["lead_time"] == "LeadTime" and m.mapped["adr"] == "avg_price_per_room"
    assert m.mapped["arrival_date"] == "arrival_date"
    r = row(prepare_features(df))
    assert r["arrival_date"] == dt.date(2016, 3, 5)
    assert r["arrival_date_month"] == "March" and r["arrival_date_year"] == 2016 and r["arrival_season"] == "spring"
    assert r["lead_time"] == 12 and r["adr"] == 99.5 and r["meal"] == "HB"


def test_day_number_in_arrival_date_is_day_of_month(spark):
    df = frame(spark, [dict(BOOKING, arrival_date="17")])
    df = df.drop("arrival_date_day_of_month")
    r = row(prepare_features(df))
    assert r["arrival_date_day_of_month"] == 17.0 and r["arrival_date"] == dt.date(2017, 8, 17)
    m = resolve_columns(df.selectExpr("cast(arrival_date as int) as arrival_date"))  # a number is never a date
    assert m.mapped == {"arrival_date_day_of_month": "arrival_date"}


@pytest.mark.parametrize("value,expected", [("8", "August"), ("aug", "August"), ("August", "August"),
                                            ("12", "December"), ("Foo", "Foo")])
def test_month_normalisation(spark, value, expected):
    r = row(prepare_features(frame(spark, [dict(BOOKING, arrival_date_month=value)])))
    assert r["arrival_date_month"] == expected


def test_validation_report_grades(spark):
    full = validate_input(spark, frame(spark, [BOOKING]), allow_defaults=True).collect()[0]
    assert full["quality_status"] == "green" and full["row_count"] == 1
    partial = {k: v for k, v in BOOKING.items() if k not in ("meal", "babies")}
    rep = validate_input(spark, frame(spark, [partial]), allow_defaults=True).collect()[0]
    assert rep["quality_status"] == "yellow" and sorted(rep["defaulted_columns"]) == ["babies", "meal"]
    strict = validate_input(spark, frame(spark, [partial]), allow_defaults=False).collect()[0]
    assert strict["quality_status"] == "red"


def test_each_date_value_decides_for_itself(spark):
    from stayguard.operators.features import prepare_features
    from stayguard.operators.schema import validate_input
    rows = [dict(BOOKING, booking_id="a", arrival_date="2016-03-15"), dict(BOOKING, booking_id="b", arrival_date="7"),
            dict(BOOKING, booking_id="c", arrival_date="15/03/2016"), dict(BOOKING, booking_id="d", arrival_date=None)]
    for r in rows:
        r.pop("arrival_date_day_of_month")
    df = frame(spark, rows)
    got = {r["booking_id"]: (str(r["arrival_date"]), r["arrival_date_day_of_month"]) for r in prepare_features(df).collect()}
    assert got == {"a": ("2016-03-15", 15.0), "b": ("2017-08-07", 7.0), "c": ("None", 1.0), "d": ("None", 1.0)}
    assert validate_input(spark, df).first()["unparsed_dates"] == 1


def test_null_flags_and_scores_stay_null_or_fall_back(spark):
    from pyspark.sql import functions as F
    from stayguard.operators.business import enrich_predictions
    from stayguard.operators.features import prepare_features
    df = frame(spark, [dict(BOOKING, company="40")]).withColumn("has_company", F.lit(None).cast("string"))
    p = prepare_features(df)
    assert p.first()["has_company"] == 1.0
    out = enrich_predictions(p.withColumn("raw_score", F.lit(None).cast("double"))).first()
    assert out["risk_score"] is None and out["cancellation_probability"] is None


def test_given_month_number_is_kept(spark):
    from stayguard.operators.features import prepare_features
    row = {k: v for k, v in BOOKING.items() if k != "arrival_date_month"}
    assert prepare_features(frame(spark, [dict(row, arrival_month_num=5)])).first()["arrival_month_num"] == 5.0
