"""Prepared modelling tables (P14, P15, U1): two sources in one schema of 44 columns.

Each is one projection and one row filter, so nothing shuffles; ids are given by the caller
(``with_row_index``) where a source has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import date_from_parts, month_name_from_num, month_num_from_name, season
from ..functions.constants import DATASET_ADDITIONAL, DATASET_COLUMNS, DATASET_MAIN, SPLIT_TRAIN_CUTOFF, SPLIT_VALID_CUTOFF
from ..sources.bookings import split_label
from .analyze import sanity_filter


def _flags(weekend: Column, children: Column, cancellations: Column, requests: Column, lead: Column) -> dict[str, Column]:
    return {
        "has_children": (children > 0).cast("long"),
        "has_previous_cancellations": (cancellations > 0).cast("long"),
        "has_special_requests": (requests > 0).cast("long"),
        "is_long_lead_booking": (lead > 90).cast("long"),
        "is_weekend_stay": (weekend > 0).cast("long"),
    }


def _typed(df: DataFrame) -> DataFrame:
    """The 44 columns with the types of DATASET_COLUMNS, rows that pass the sanity filter."""
    return sanity_filter(df).select(*[F.col(c).cast(t).alias(c) for c, t in DATASET_COLUMNS.items()])


def prepare_main(raw: DataFrame, train_cutoff: str = SPLIT_TRAIN_CUTOFF, valid_cutoff: str = SPLIT_VALID_CUTOFF) -> DataFrame:
    """The first source, with its arrival date built from the date parts."""
    month = month_num_from_name(F.col("arrival_date_month"))
    arrival = date_from_parts(F.col("arrival_date_year"), month, F.col("arrival_date_day_of_month"))
    out = raw.withColumns({"arrival_month_num": month, "arrival_date": arrival, "children": F.coalesce(F.col("children"), F.lit(0))})
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    created = F.date_sub("arrival_date", F.col("lead_time").cast("int"))
    out = out.withColumns({
        "source_dataset": F.lit(DATASET_MAIN),
        "booking_creation_date": created,
        "split": split_label(created, train_cutoff, valid_cutoff),
        "arrival_season": season(F.col("arrival_month_num")),
        "total_nights": nights,
        "total_guests": F.col("adults") + F.col("children") + F.col("babies"),
        "country_missing": F.col("country").isNull().cast("long"),
        "agent_missing": F.col("agent").isNull().cast("long"),
        "has_company": F.col("company").isNotNull().cast("long"),
        "booking_value": F.col("adr") * nights,
        **_flags(F.col("stays_in_weekend_nights"), F.col("children") + F.col("babies"), F.col("previous_cancellations"),
                 F.col("total_of_special_requests"), F.col("lead_time")),
    })
    out = out.withColumns({"country": F.coalesce(F.col("country"), F.lit("Unknown")),
                           "agent": F.coalesce(F.col("agent").cast("long"), F.lit(0)).cast("string")})
    return _typed(out)


def prepare_additional(raw: DataFrame) -> DataFrame:
    """The second source harmonised to the same columns; what it does not have is unknown."""
    c = F.col
    unknown = ("hotel", "country", "distribution_channel", "deposit_type", "agent", "customer_type")
    renamed = {
        "booking_id": "Booking_ID", "adults": "no_of_adults", "children": "no_of_children",
        "stays_in_weekend_nights": "no_of_weekend_nights", "stays_in_week_nights": "no_of_week_nights",
        "meal": "type_of_meal_plan", "required_car_parking_spaces": "required_car_parking_space",
        "reserved_room_type": "room_type_reserved", "lead_time": "lead_time", "arrival_date_year": "arrival_year",
        "arrival_month_num": "arrival_month", "arrival_date_day_of_month": "arrival_date", "market_segment": "market_segment_type",
        "is_repeated_guest": "repeated_guest", "previous_cancellations": "no_of_previous_cancellations",
        "previous_bookings_not_canceled": "no_of_previous_bookings_not_canceled", "adr": "avg_price_per_room",
        "total_of_special_requests": "no_of_special_requests",
    }
    out = raw.select(*[c(source).alias(name) for name, source in renamed.items()], (c("booking_status") == "Canceled").cast("long").alias("is_canceled"))
    nights = c("stays_in_weekend_nights") + c("stays_in_week_nights")
    out = out.withColumns({
        "source_dataset": F.lit(DATASET_ADDITIONAL), "split": F.lit("external"), **{name: F.lit("Unknown") for name in unknown},
        "arrival_date": date_from_parts(c("arrival_date_year"), c("arrival_month_num"), c("arrival_date_day_of_month")),
        "arrival_date_month": month_name_from_num(c("arrival_month_num")), "arrival_date_week_number": F.lit(None).cast("double"),
        "arrival_season": season(c("arrival_month_num")), "babies": F.lit(0), "country_missing": F.lit(1), "agent_missing": F.lit(1),
        "has_company": F.lit(0), "total_nights": nights, "total_guests": c("adults") + c("children"), "booking_value": c("adr") * nights,
        **_flags(c("stays_in_weekend_nights"), c("children"), c("previous_cancellations"), c("total_of_special_requests"), c("lead_time")),
    })
    return _typed(out.withColumn("booking_creation_date", F.date_sub("arrival_date", c("lead_time").cast("int"))))


def combined(main: DataFrame, additional: DataFrame) -> DataFrame:
    """Both tables, one after the other; the id is text in both."""
    return main.withColumn("booking_id", F.col("booking_id").cast("string")).unionByName(additional)
