from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stayguard.session import local_session
    s = local_session(cpus="*", shuffle_partitions=8, app="stayguard-tests")
    yield s
    s.stop()


BOOKING = {
    "booking_id": "B-1", "hotel": "City Hotel", "lead_time": 145, "arrival_date_year": 2017,
    "arrival_date_month": "August", "arrival_date_week_number": 32, "arrival_date_day_of_month": 10,
    "stays_in_weekend_nights": 1, "stays_in_week_nights": 2, "adults": 2, "children": 0, "babies": 0, "meal": "BB",
    "country": "PRT", "market_segment": "Online TA", "distribution_channel": "TA/TO", "is_repeated_guest": 0,
    "previous_cancellations": 1, "previous_bookings_not_canceled": 0, "reserved_room_type": "A",
    "deposit_type": "No Deposit", "customer_type": "Transient", "adr": 120.0, "required_car_parking_spaces": 0,
    "total_of_special_requests": 0,
}

SECOND = dict(BOOKING, booking_id="B-2", hotel="Resort Hotel", lead_time=3, market_segment="Direct",
              distribution_channel="Direct", is_repeated_guest=1, previous_cancellations=0, deposit_type="Non Refund",
              adr=80.0, required_car_parking_spaces=1, total_of_special_requests=2)


def frame(spark, rows: list[dict]):
    """All-text frame, like a CSV read without a schema."""
    cols = list(dict.fromkeys(k for r in rows for k in r))
    data = [tuple(None if r.get(c) is None else str(r.get(c)) for c in cols) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in cols))


@pytest.fixture
def one_booking(spark):
    return frame(spark, [BOOKING])


@pytest.fixture
def two_bookings(spark):
    return frame(spark, [BOOKING, SECOND])
