"""SQL texts for the DuckDB oracle: the booking view, and independent SQL versions of
feature preparation and rule scoring on it. Each oracle query appends its own
CTEs / final SELECT to ``BASE``. Rules for a clean match: doubles are forced
(``::DOUBLE``) wherever Spark computes in double, every double is rounded to 6
places in the final projection, counts are BIGINT. ``$NAME$`` stands for the text
constant of that name.
"""

import re

from ..functions import constants


def with_texts(sql: str) -> str:
    """The SQL with its text constants filled in."""
    return re.sub(r"\$([A-Z][A-Z0-9_]*)\$", lambda m: getattr(constants, m[1]).replace("'", "''"), sql)


BOOKING_VIEW = """
WITH li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret
  FROM lineitem GROUP BY l_orderkey
), b0 AS (
  SELECT o.o_orderkey AS booking_id,
    CASE WHEN o.o_orderkey % 3 = 0 THEN 'Resort Hotel' ELSE 'City Hotel' END AS hotel,
    CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_canceled,
    CASE WHEN o.o_orderstatus <> 'F' THEN 'Check-Out'
         WHEN o.o_orderkey % 40 = 0 THEN 'No-Show' ELSE 'Canceled' END AS reservation_status,
    CAST((o.o_orderkey * 37) % 401 AS INT) AS lead_time,
    CAST(o.o_orderdate AS DATE) AS booking_creation_date,
    CAST(o.o_orderdate AS DATE) + CAST((o.o_orderkey * 37) % 401 AS INT) AS arrival_date,
    CAST((o.o_orderkey * 5) % 3 AS INT) AS stays_in_weekend_nights,
    CAST((o.o_orderkey * 11) % 6 AS INT) AS stays_in_week_nights,
    CAST((o.o_orderkey * 13) % 4 AS INT) AS adults,
    CASE WHEN o.o_orderkey % 251 = 0 THEN NULL ELSE CAST((o.o_orderkey * 17) % 3 AS INT) END AS children,
    CAST(CASE WHEN o.o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS INT) AS babies,
    CASE CAST(o.o_orderkey % 4 AS INT) WHEN 0 THEN 'BB' WHEN 1 THEN 'HB' WHEN 2 THEN 'SC' ELSE 'FB' END AS meal,
    CASE WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE n.n_name END AS country,
    CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'Online TA' WHEN 'AUTOMOBILE' THEN 'Groups'
         WHEN 'BUILDING' THEN 'Direct' WHEN 'HOUSEHOLD' THEN 'Corporate' ELSE 'Offline TA/TO' END AS market_segment,
    CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Direct' WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Corporate' ELSE 'TA/TO' END AS distribution_channel,
    CAST(CASE WHEN o.o_custkey % 10 = 0 THEN 1 ELSE 0 END AS INT) AS is_repeated_guest,
    CAST(CASE WHEN COALESCE(li.n_ret, 0) > 3 THEN li.n_ret - 3 ELSE 0 END AS INT) AS previous_cancellations,
    CAST(o.o_custkey % 5 AS INT) AS previous_bookings_not_canceled,
    CASE CAST(o.o_orderkey % 5 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN 'F' ELSE 'G' END AS reserved_room_type,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Non Refund' WHEN '2-HIGH' THEN 'Refundable' ELSE 'No Deposit' END AS deposit_type,
    CASE WHEN o.o_orderstatus = 'P' THEN 'Transient-Party' ELSE 'Transient' END AS customer_type,
    CASE WHEN o.o_custkey % 7 = 0 THEN NULL ELSE CAST(o.o_custkey % 97 AS STRING) END AS agent,
    CASE WHEN o.o_custkey % 17 = 0 THEN CAST(o.o_custkey % 31 AS STRING) ELSE NULL END AS company_raw,
    ROUND(o.o_totalprice / 1000.0, 2) AS adr,
    CAST(CASE WHEN o.o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS INT) AS required_car_parking_spaces,
    CAST(COALESCE(li.n_lines, 0) % 4 AS INT) AS total_of_special_requests
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
), bookings AS (
  SELECT b0.*, CASE WHEN booking_creation_date <= DATE '1999-06-30' THEN 'train'
                    WHEN booking_creation_date <= DATE '2000-06-30' THEN 'valid' ELSE 'test' END AS split
  FROM b0)
"""

# Feature preparation on the (complete, clean-typed) booking view, written directly in SQL.
PREPARED = """
, p0 AS (
  SELECT booking_id, is_canceled, split, booking_creation_date, arrival_date, hotel, meal,
    COALESCE(country, 'Unknown') AS country, market_segment, distribution_channel, reserved_room_type,
    deposit_type, customer_type,
    COALESCE(agent, 'Unknown') AS agent, COALESCE(company_raw, 'Unknown') AS company_raw,
    CASE WHEN country IS NULL THEN 1 ELSE 0 END AS country_missing,
    CASE WHEN agent IS NULL THEN 1 ELSE 0 END AS agent_missing,
    CASE WHEN company_raw IS NULL THEN 0 ELSE 1 END AS has_company,
    GREATEST(CAST(lead_time AS DOUBLE), 0.0::DOUBLE) AS lead_time,
    GREATEST(CAST(adr AS DOUBLE), 0.0::DOUBLE) AS adr,
    GREATEST(CAST(stays_in_weekend_nights AS DOUBLE), 0.0::DOUBLE) AS stays_in_weekend_nights,
    GREATEST(CAST(stays_in_week_nights AS DOUBLE), 0.0::DOUBLE) AS stays_in_week_nights,
    CAST(adults AS DOUBLE) AS adults,
    COALESCE(CAST(children AS DOUBLE), 0.0::DOUBLE) AS children,
    CAST(babies AS DOUBLE) AS babies,
    LEAST(GREATEST(CAST(is_repeated_guest AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS is_repeated_guest,
    GREATEST(CAST(previous_cancellations AS DOUBLE), 0.0::DOUBLE) AS previous_cancellations,
    GREATEST(CAST(previous_bookings_not_canceled AS DOUBLE), 0.0::DOUBLE) AS previous_bookings_not_canceled,
    GREATEST(CAST(required_car_parking_spaces AS DOUBLE), 0.0::DOUBLE) AS required_car_parking_spaces,
    GREATEST(CAST(total_of_special_requests AS DOUBLE), 0.0::DOUBLE) AS total_of_special_requests,
    CAST(year(arrival_date) AS DOUBLE) AS arrival_date_year,
    CAST(month(arrival_date) AS DOUBLE) AS arrival_month_num,
    monthname(arrival_date) AS arrival_date_month,
    CAST(weekofyear(arrival_date) AS DOUBLE) AS arrival_date_week_number,
    CAST(dayofmonth(arrival_date) AS DOUBLE) AS arrival_date_day_of_month,
    CAST(isodow(arrival_date) - 1 AS INT) AS arrival_dayofweek
  FROM bookings
), p1 AS (
  SELECT *,
    CASE WHEN stays_in_weekend_nights + stays_in_week_nights <= 0 THEN 1.0::DOUBLE
         ELSE stays_in_weekend_nights + stays_in_week_nights END AS total_nights,
    CASE WHEN adults + children + babies <= 0 THEN 1.0::DOUBLE ELSE adults + children + babies END AS total_guests,
    CASE WHEN arrival_month_num IN (12, 1, 2) THEN 'winter' WHEN arrival_month_num IN (3, 4, 5) THEN 'spring'
         WHEN arrival_month_num IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS arrival_season,
    CAST(CEIL(arrival_month_num / 3.0) AS INT) AS arrival_quarter
  FROM p0
), prepared AS (
  SELECT *, adr * total_nights AS booking_value FROM p1
)
"""

SCORED = """
, s0 AS (
  SELECT *,
    LEAST(GREATEST(
      0.12::DOUBLE
      + CASE WHEN lead_time > 90 THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN lead_time > 180 THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN deposit_type = 'No Deposit' THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN market_segment IN ('Online TA', 'Groups') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN distribution_channel = 'TA/TO' THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN previous_cancellations > 0 THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN total_of_special_requests = 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN required_car_parking_spaces > 0 THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN is_repeated_guest = 1 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END,
      0.02::DOUBLE), 0.98::DOUBLE) AS risk_score,
    CASE WHEN deposit_type = 'Non Refund' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS deposit_loss_factor
  FROM prepared
), s1 AS (
  SELECT *, risk_score AS cancellation_probability,
    CASE WHEN risk_score >= 0.80::DOUBLE THEN 'Critical' WHEN risk_score >= 0.60::DOUBLE THEN 'High'
         WHEN risk_score >= 0.30::DOUBLE THEN 'Medium' ELSE 'Low' END AS risk_category,
    risk_score * GREATEST(booking_value, 0.0::DOUBLE) * deposit_loss_factor AS expected_loss
  FROM s0
), scored AS (
  SELECT *, expected_loss AS business_priority_score,
    (risk_category IN ('High', 'Critical') AND expected_loss >= 100.0::DOUBLE) AS actionable,
    CASE WHEN risk_category IN ('High', 'Critical') AND expected_loss < 100.0::DOUBLE THEN '$ACTION_LOW_FINANCIAL_PRIORITY$'
         WHEN risk_category = 'Critical' THEN '$ACTION_MANUAL_REVIEW$'
         WHEN risk_category = 'High' THEN '$ACTION_DEPOSIT_REVIEW$'
         WHEN risk_category = 'Medium' THEN '$ACTION_CONFIRMATION$'
         ELSE '$ACTION_NO_ACTION$' END AS recommended_action
  FROM s1
)
"""

BASE = BOOKING_VIEW + PREPARED + SCORED
