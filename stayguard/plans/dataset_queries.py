"""Prepared tables, split strategy and messy input.

The messy input is derived from the booking view by expressions that DuckDB repeats, so each
oracle computes the answer from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.constants import CATEGORICAL_FEATURES, FEATURE_COLUMNS, NUMERIC_FEATURES, TARGET_ENCODING_OUTPUT_FEATURES
from ..operators import datasets as D
from ..session import ensure_checkpoint_dir
from ..sources.bookings import TRAIN_CUTOFF, VALID_CUTOFF, second_source
from . import inputs
from .catalog import r6, register


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------
# prepared modelling tables
# ---------------------------------------------------------------------------

PREPARED_MAIN_SQL = """
, pm AS (
  SELECT 'hotel_booking_demand' AS source_dataset, CAST(booking_id AS VARCHAR) AS booking_id, split, hotel, CAST(is_canceled AS BIGINT) AS is_canceled,
    CAST(lead_time AS BIGINT) AS lead_time, arrival_date, booking_creation_date, CAST(year(arrival_date) AS BIGINT) AS arrival_date_year,
    CAST(month(arrival_date) AS BIGINT) AS arrival_month_num, monthname(arrival_date) AS arrival_date_month,
    CAST(weekofyear(arrival_date) AS DOUBLE) AS arrival_date_week_number, CAST(day(arrival_date) AS BIGINT) AS arrival_date_day_of_month,
    CASE WHEN month(arrival_date) IN (12, 1, 2) THEN 'winter' WHEN month(arrival_date) IN (3, 4, 5) THEN 'spring'
         WHEN month(arrival_date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS arrival_season,
    CAST(stays_in_weekend_nights AS BIGINT) AS stays_in_weekend_nights, CAST(stays_in_week_nights AS BIGINT) AS stays_in_week_nights,
    CAST(stays_in_weekend_nights + stays_in_week_nights AS BIGINT) AS total_nights, CAST(adults AS BIGINT) AS adults,
    CAST(COALESCE(children, 0) AS BIGINT) AS children, CAST(babies AS BIGINT) AS babies,
    CAST(adults + COALESCE(children, 0) + babies AS BIGINT) AS total_guests,
    CAST(CASE WHEN COALESCE(children, 0) + babies > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_children, meal, COALESCE(country, 'Unknown') AS country,
    CAST(CASE WHEN country IS NULL THEN 1 ELSE 0 END AS BIGINT) AS country_missing, market_segment, distribution_channel,
    CAST(is_repeated_guest AS BIGINT) AS is_repeated_guest, CAST(previous_cancellations AS BIGINT) AS previous_cancellations,
    CAST(previous_bookings_not_canceled AS BIGINT) AS previous_bookings_not_canceled,
    CAST(CASE WHEN previous_cancellations > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_previous_cancellations, reserved_room_type, deposit_type,
    COALESCE(agent, '0') AS agent, CAST(CASE WHEN agent IS NULL THEN 1 ELSE 0 END AS BIGINT) AS agent_missing,
    CAST(CASE WHEN company_raw IS NULL THEN 0 ELSE 1 END AS BIGINT) AS has_company, customer_type, ROUND(adr, 6) AS adr,
    ROUND(adr * (stays_in_weekend_nights + stays_in_week_nights), 6) AS booking_value,
    CAST(required_car_parking_spaces AS BIGINT) AS required_car_parking_spaces, CAST(total_of_special_requests AS BIGINT) AS total_of_special_requests,
    CAST(CASE WHEN total_of_special_requests > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_special_requests,
    CAST(CASE WHEN lead_time > 90 THEN 1 ELSE 0 END AS BIGINT) AS is_long_lead_booking,
    CAST(CASE WHEN stays_in_weekend_nights > 0 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend_stay
  FROM bookings
  WHERE adults + COALESCE(children, 0) + babies > 0 AND stays_in_weekend_nights + stays_in_week_nights > 0 AND adr >= 0
)"""
PREPARED_SECOND_SQL = """
, pa AS (
  SELECT 'hotel_reservations_classification' AS source_dataset, 'INN' || booking_id AS booking_id, 'external' AS split, 'Unknown' AS hotel,
    CAST(is_canceled AS BIGINT) AS is_canceled, CAST(lead_time AS BIGINT) AS lead_time, arrival_date, booking_creation_date,
    CAST(year(arrival_date) AS BIGINT) AS arrival_date_year, CAST(month(arrival_date) AS BIGINT) AS arrival_month_num,
    monthname(arrival_date) AS arrival_date_month, CAST(NULL AS DOUBLE) AS arrival_date_week_number,
    CAST(day(arrival_date) AS BIGINT) AS arrival_date_day_of_month,
    CASE WHEN month(arrival_date) IN (12, 1, 2) THEN 'winter' WHEN month(arrival_date) IN (3, 4, 5) THEN 'spring'
         WHEN month(arrival_date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS arrival_season,
    CAST(stays_in_weekend_nights AS BIGINT) AS stays_in_weekend_nights, CAST(stays_in_week_nights AS BIGINT) AS stays_in_week_nights,
    CAST(stays_in_weekend_nights + stays_in_week_nights AS BIGINT) AS total_nights, CAST(adults AS BIGINT) AS adults,
    CAST(COALESCE(children, 0) AS BIGINT) AS children, CAST(0 AS BIGINT) AS babies, CAST(adults + COALESCE(children, 0) AS BIGINT) AS total_guests,
    CAST(CASE WHEN COALESCE(children, 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_children, meal, 'Unknown' AS country, CAST(1 AS BIGINT) AS country_missing,
    market_segment, 'Unknown' AS distribution_channel, CAST(is_repeated_guest AS BIGINT) AS is_repeated_guest,
    CAST(previous_cancellations AS BIGINT) AS previous_cancellations, CAST(previous_bookings_not_canceled AS BIGINT) AS previous_bookings_not_canceled,
    CAST(CASE WHEN previous_cancellations > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_previous_cancellations, reserved_room_type,
    'Unknown' AS deposit_type, 'Unknown' AS agent, CAST(1 AS BIGINT) AS agent_missing, CAST(0 AS BIGINT) AS has_company, 'Unknown' AS customer_type,
    ROUND(adr, 6) AS adr, ROUND(adr * (stays_in_weekend_nights + stays_in_week_nights), 6) AS booking_value,
    CAST(required_car_parking_spaces AS BIGINT) AS required_car_parking_spaces, CAST(total_of_special_requests AS BIGINT) AS total_of_special_requests,
    CAST(CASE WHEN total_of_special_requests > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_special_requests,
    CAST(CASE WHEN lead_time > 90 THEN 1 ELSE 0 END AS BIGINT) AS is_long_lead_booking,
    CAST(CASE WHEN stays_in_weekend_nights > 0 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend_stay
  FROM bookings
  WHERE adults + COALESCE(children, 0) > 0 AND stays_in_weekend_nights + stays_in_week_nights > 0 AND adr >= 0
)"""


def _raw_first_source(spark, sf):
    """The booking view as the first source's raw file: date parts only, ``company``."""
    raw = inputs.raw(spark, sf)
    return raw.withColumns({
        "arrival_date_year": F.year("arrival_date"), "arrival_date_month": F.date_format("arrival_date", "MMMM"),
        "arrival_date_day_of_month": F.dayofmonth("arrival_date"), "arrival_date_week_number": F.weekofyear("arrival_date"),
    }).withColumnRenamed("company_raw", "company").drop("arrival_date", "booking_creation_date", "split")


def prepared_main(spark, sf):
    return D.prepare_main(_raw_first_source(spark, sf), TRAIN_CUTOFF, VALID_CUTOFF)


def prepared_second(spark, sf):
    return D.prepare_additional(second_source(inputs.raw(spark, sf)))


def _rounded(df):
    return df.withColumns({"adr": r6("adr"), "booking_value": r6("booking_value")})


@register("prepared_main", PREPARED_MAIN_SQL + " SELECT * FROM pm")
def q_prepared_main(spark, sf):
    """The first source as the 44-column table"""
    return _rounded(prepared_main(spark, sf))


@register("prepared_second", PREPARED_SECOND_SQL + " SELECT * FROM pa")
def q_prepared_second(spark, sf):
    """The second source harmonised to the 44 columns"""
    return _rounded(prepared_second(spark, sf))


UNION_SQL = PREPARED_MAIN_SQL + PREPARED_SECOND_SQL + ", unioned AS (SELECT * FROM pm UNION ALL SELECT * FROM pa)"


@register("union_sources", UNION_SQL + " SELECT * FROM unioned")
def q_union_sources(spark, sf):
    """Both prepared tables in one"""
    return _rounded(D.combined(prepared_main(spark, sf), prepared_second(spark, sf)))


@register("source_compare", UNION_SQL + """
SELECT source_dataset, COUNT(*) AS rows, ROUND(AVG(CAST(is_canceled AS DOUBLE)), 6) AS cancel_rate,
  MIN(arrival_date) AS min_arrival, MAX(arrival_date) AS max_arrival, ROUND(AVG(adr), 6) AS mean_adr
FROM unioned GROUP BY source_dataset
""")
def q_source_compare(spark, sf):
    """A18"""
    u = D.combined(prepared_main(spark, sf), prepared_second(spark, sf))
    return u.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.avg("is_canceled"), "cancel_rate"),
        F.min("arrival_date").alias("min_arrival"), F.max("arrival_date").alias("max_arrival"), r6(F.avg("adr"), "mean_adr"))


# ---------------------------------------------------------------------------
# split strategy
# ---------------------------------------------------------------------------

@register("split_derived", "SELECT booking_id, split FROM bookings")
def q_split_derived(spark, sf):
    """D3 + D8 + D10: no creation date in the input; it is derived from arrival and lead time"""
    from ..operators.rank import assign_split
    raw = inputs.raw(spark, sf).drop("booking_creation_date", "split")
    out, how = assign_split(raw, train_cutoff=TRAIN_CUTOFF, valid_cutoff=VALID_CUTOFF)
    if how != "booking_creation_date":
        raise RuntimeError(how)
    return out.select("booking_id", "split")


_DRAW = "CAST('0x' || substr(md5('{seed}:INN' || booking_id), 1, 15) AS BIGINT) % 100"


@register("split_random", f"""
SELECT 'INN' || booking_id AS booking_id, CASE WHEN {_DRAW.format(seed=42)} < 20 THEN 'test' WHEN {_DRAW.format(seed=43)} < 20 THEN 'valid' ELSE 'train' END AS split
FROM bookings
""")
def q_split_random(spark, sf):
    """U4: seeded 64 / 16 / 20 split of text ids"""
    from ..operators.rank import random_split
    ids = inputs.raw(spark, sf).select(F.concat(F.lit("INN"), F.col("booking_id").cast("string")).alias("booking_id"))
    return random_split(ids, 42)


# ---------------------------------------------------------------------------
# messy input
# ---------------------------------------------------------------------------

ALIASES = {"booking_id": "Booking ID", "lead_time": "LeadTime", "adr": "avg price per room", "stays_in_week_nights": "no_of_week_nights",
           "adults": "No Of Adults", "meal": "type_of_meal_plan", "market_segment": "market_segment_type", "company_raw": "company"}


def messy(spark, sf):
    """The booking view as text under alias names, with bad cells, NULL ids and text sentinels."""
    raw = inputs.raw(spark, sf)
    k = F.col("booking_id")
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns if c not in ("booking_creation_date", "split", "is_canceled", "reservation_status")])
    bad = {
        "adr": F.when(k % 7 == 0, "abc").when(k % 7 == 1, "NaN").when(k % 7 == 2, "Infinity").otherwise(F.col("adr")),
        "lead_time": F.when(k % 11 == 0, "-5").when(k % 11 == 1, "").otherwise(F.col("lead_time")),
        "country": F.when(k % 13 == 0, "nan").when(k % 13 == 1, "None").otherwise(F.col("country")),
        "arrival_date": F.when(k % 17 == 0, "15/03/2016").otherwise(F.col("arrival_date")),
        "is_repeated_guest": F.when(k % 19 == 0, "7").otherwise(F.col("is_repeated_guest")),
    }
    return text.withColumns({c: v for c, v in bad.items()}).withColumnsRenamed(ALIASES).drop("customer_type")


MESSY_SQL = """
, m0 AS (
  SELECT *, CASE WHEN booking_id % 7 IN (0, 1) THEN 0.0::DOUBLE WHEN booking_id % 7 = 2 THEN 'Infinity'::DOUBLE ELSE adr END AS m_adr,
    CASE WHEN booking_id % 11 IN (0, 1) THEN 0.0::DOUBLE ELSE CAST(lead_time AS DOUBLE) END AS m_lead,
    CASE WHEN booking_id % 13 IN (0, 1) THEN 'Unknown' ELSE COALESCE(country, 'Unknown') END AS m_country,
    CASE WHEN booking_id % 17 = 0 THEN NULL ELSE arrival_date END AS m_arrival,
    CASE WHEN booking_id % 19 = 0 THEN 1.0::DOUBLE ELSE CAST(is_repeated_guest AS DOUBLE) END AS m_repeat,
    CAST(stays_in_weekend_nights + stays_in_week_nights AS DOUBLE) AS m_n
  FROM bookings
), m1 AS (SELECT *, CASE WHEN m_n <= 0 THEN 1.0::DOUBLE ELSE m_n END AS nights FROM m0)
SELECT CAST(booking_id AS VARCHAR) AS booking_id, m_arrival AS arrival_date, CASE WHEN isinf(m_adr) THEN 0.0 ELSE ROUND(m_adr, 6) END AS adr,
  m_lead AS lead_time, m_country AS country, CAST(CASE WHEN country IS NULL AND booking_id % 13 NOT IN (0, 1) THEN 1 ELSE 0 END AS INT) AS country_missing,
  m_repeat AS is_repeated_guest, nights AS total_nights,
  CASE WHEN isinf(m_adr) THEN 0.0 ELSE ROUND(m_adr * nights, 6) END AS booking_value,
  CAST(CASE WHEN company_raw IS NULL THEN 0 ELSE 1 END AS INT) AS has_company, 'Transient' AS customer_type, meal, market_segment,
  CAST(CASE WHEN booking_id % 17 = 0 THEN 1 ELSE month(arrival_date) END AS INT) AS arrival_month_num,
  CAST(CASE WHEN booking_id % 17 = 0 THEN 1 ELSE day(arrival_date) END AS INT) AS arrival_day, CAST(0 AS BIGINT) AS placeholders
FROM m1
"""


@register("messy_prepared", MESSY_SQL)
def q_messy_prepared(spark, sf):
    """Alias names, bad text, NaN, infinity, sentinels, a missing column"""
    from ..operators.features import model_matrix, prepare_features
    p = prepare_features(messy(spark, sf))
    model_matrix(p)
    zero = sum((F.col(c) for c in TARGET_ENCODING_OUTPUT_FEATURES), F.lit(0.0))
    return p.select("booking_id", "arrival_date", r6("adr"), "lead_time", "country", F.col("country_missing").cast("int").alias("country_missing"),
                    "is_repeated_guest", "total_nights", r6("booking_value"), F.col("has_company").cast("int").alias("has_company"), "customer_type",
                    "meal", "market_segment", F.col("arrival_month_num").cast("int").alias("arrival_month_num"),
                    F.col("arrival_date_day_of_month").cast("int").alias("arrival_day"), zero.cast("long").alias("placeholders"))


@register("feature_columns", f"""
SELECT COUNT(*) AS rows, CAST({len(FEATURE_COLUMNS)} AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS null_numbers, CAST(0 AS BIGINT) AS null_texts FROM bookings
""")
def q_feature_columns(spark, sf):
    """P12 + P16: no number of the model matrix is NULL, NaN or infinite and no category is NULL, however messy the input"""
    from ..operators.features import model_matrix, prepare_features
    m = model_matrix(prepare_features(messy(spark, sf)))
    bad = sum(((F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("long") for c in NUMERIC_FEATURES), F.lit(0))
    return m.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(m.columns)).cast("long").alias("n_columns"), F.sum(bad).alias("null_numbers"),
                 F.sum(sum((F.col(c).isNull().cast("long") for c in CATEGORICAL_FEATURES), F.lit(0))).alias("null_texts"))


def _report(v):
    return v.select("row_count", "column_count", "quality_status", r6("schema_confidence"), r6("defaulted_ratio"),
                    F.array_join("defaulted_columns", ", ").alias("defaulted_columns"), F.array_join("ignored_columns", ", ").alias("ignored_columns"),
                    F.size("warnings").cast("long").alias("n_warnings"), "unparsed_dates",
                    F.array_join(F.array_sort(F.map_values("mapped_columns")), ", ").alias("sources"))


def _report_sql(status: str, columns: int, missing: list[str], ignored: list[str], n_warnings: int, sources: list[str], unparsed: str) -> str:
    from ..functions.constants import REQUIRED_COLUMNS
    ratio = len(missing) / len(REQUIRED_COLUMNS)
    return f"""
SELECT COUNT(*) AS row_count, {columns} AS column_count, '{status}' AS quality_status, ROUND({1 - ratio!r}::DOUBLE, 6) AS schema_confidence,
  ROUND({ratio!r}::DOUBLE, 6) AS defaulted_ratio, '{", ".join(missing)}' AS defaulted_columns, '{", ".join(ignored)}' AS ignored_columns,
  CAST({n_warnings} AS BIGINT) AS n_warnings, {unparsed} AS unparsed_dates, '{", ".join(sorted(sources))}' AS sources
FROM bookings"""


_MESSY_SOURCES = ["Booking ID", "hotel", "LeadTime", "arrival_date", "stays_in_weekend_nights", "no_of_week_nights", "No Of Adults", "children", "babies",
                  "type_of_meal_plan", "country", "market_segment_type", "distribution_channel", "is_repeated_guest", "previous_cancellations",
                  "previous_bookings_not_canceled", "reserved_room_type", "deposit_type", "avg price per room", "required_car_parking_spaces",
                  "total_of_special_requests", "agent", "company"]
_UNPARSED = "COUNT(*) FILTER (WHERE booking_id % 17 = 0)"


@register("validation_yellow", _report_sql("yellow", 23, ["customer_type"], ["country"], 2, _MESSY_SOURCES, _UNPARSED))
def q_validation_yellow(spark, sf):
    """One required column is missing and filled, defaults allowed; unparsed dates are counted"""
    from ..operators.schema import validate_input
    return _report(validate_input(spark, messy(spark, sf), allow_defaults=True))


_RED = ["meal", "market_segment", "distribution_channel", "reserved_room_type", "deposit_type", "customer_type"]


@register("validation_red", _report_sql("red", 18, _RED, ["country"], 2, [s for s in _MESSY_SOURCES if s not in (
    "type_of_meal_plan", "market_segment_type", "distribution_channel", "reserved_room_type", "deposit_type")], _UNPARSED))
def q_validation_red(spark, sf):
    """Too many columns are filled"""
    from ..operators.schema import validate_input
    return _report(validate_input(spark, messy(spark, sf).drop(*(ALIASES.get(c, c) for c in _RED)), allow_defaults=True))


@register("validation_strict", _report_sql("red", 23, ["customer_type"], ["country"], 2, _MESSY_SOURCES, _UNPARSED))
def q_validation_strict(spark, sf):
    """P6 + P7: strict mode; preparation refuses the same input before any job runs"""
    from ..operators.features import prepare_features
    from ..operators.schema import validate_input
    m = messy(spark, sf)
    try:
        prepare_features(m, strict=True)
    except ValueError as e:
        if "customer_type" not in str(e):
            raise
    else:
        raise RuntimeError("strict mode took an incomplete input")
    return _report(validate_input(spark, m, allow_defaults=False))


# ---------------------------------------------------------------------------
# files
# ---------------------------------------------------------------------------

_HARD_TEXT = "'The \"Grand\", ' || hotel || chr(10) || 'No. ' || booking_id"


def _hard(spark, sf):
    """Fields with quotes, commas and line ends."""
    return inputs.raw(spark, sf).select("booking_id", F.concat(F.lit('The "Grand", '), "hotel", F.lit("\nNo. "), F.col("booking_id").cast("string")).alias("hotel"),
                                        F.col("adr").cast("string").alias("adr"), F.col("country"))


@register("csv_roundtrip", f"SELECT CAST(booking_id AS VARCHAR) AS booking_id, {_HARD_TEXT} AS hotel, country FROM bookings")
def q_csv_roundtrip(spark, sf):
    """S1 + S4: fields with quotes, commas and line ends written as CSV and read back"""
    from ..operators.store import write_csv
    from ..sources.readers import read_csv_files
    path = _scratch(spark, "csv")
    write_csv(_hard(spark, sf).select("booking_id", "hotel", "country"), path)
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect()]
    return read_csv_files(spark, files).select("booking_id", "hotel", "country")


@register("json_records", f"SELECT booking_id, {_HARD_TEXT} AS hotel, country FROM bookings")
def q_json_records(spark, sf):
    """JSON records written and read back (X5: a row as JSON text)"""
    from ..sources.readers import read_json_records
    path = _scratch(spark, "json")
    rows = _hard(spark, sf)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return read_json_records(spark, path).select("booking_id", "hotel", "country")


@register("surrogate_text_ids", """
SELECT COUNT(*) AS rows, COUNT(DISTINCT CASE WHEN booking_id % 3 = 0 THEN 'row-' || booking_id ELSE 'INN' || booking_id END) AS distinct_ids,
  COUNT(*) FILTER (WHERE booking_id % 3 = 0) AS given_by_engine FROM bookings
""")
def q_surrogate_text_ids(spark, sf):
    """A third of the text ids is NULL; each such row gets an id of its own, the others keep theirs"""
    from ..operators.features import prepare_features
    raw = inputs.raw(spark, sf)
    k = F.col("booking_id")
    p = prepare_features(raw.withColumn("booking_id", F.when(k % 3 != 0, F.concat(F.lit("INN"), k.cast("string")))))
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("booking_id").alias("distinct_ids"),
                 F.count_if(F.startswith("booking_id", F.lit("row-"))).alias("given_by_engine"))


@register("one_split", "SELECT booking_id, ROUND(booking_value, 6) AS booking_value FROM prepared WHERE split = 'test'")
def q_one_split(spark, sf):
    """S3: the prepared table written by split; one split is read (only its folder)"""
    from ..sources.readers import read_split, write_prepared
    path = _scratch(spark, "by-split")
    write_prepared(inputs.prepared(spark, sf).select("booking_id", "booking_value", "split"), path)
    return read_split(spark, path, "test").select("booking_id", r6("booking_value"))


@register("metrics_file", "SELECT COUNT(*) AS rows, ROUND(AVG(is_canceled), 6) AS cancel_rate FROM bookings")
def q_metrics_file(spark, sf):
    """Metrics written as JSON and read back"""
    from ..operators.store import write_metrics
    path = _scratch(spark, "metrics")
    m = inputs.raw(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.avg("is_canceled").alias("cancel_rate")).first().asDict()
    write_metrics(spark, m, path)
    return spark.read.json(path).select("rows", r6("cancel_rate"))


@register("row_limit", "SELECT COUNT(*) AS rows, COUNT(*) > 1000 AS too_many FROM bookings")
def q_row_limit(spark, sf):
    """A bound on the input rows that is met, and one that is not"""
    from ..operators.filters import check_row_limit
    raw = inputs.raw(spark, sf)
    n = check_row_limit(raw, 10 ** 12)
    try:
        check_row_limit(raw, 1000)
        over = False
    except ValueError:
        over = True
    return spark.createDataFrame([(n, over)], "rows long, too_many boolean")


_SELECTED = {"adr": "number", "babies": "number", "children": "number", "lead_time": "number", "adults": "number", "hotel": "category", "meal": "category", "country": "category"}


@register("feature_selection", " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{kind}' AS kind, COUNT({c}) AS known, COUNT(DISTINCT {c}) AS different FROM bookings" for c, kind in _SELECTED.items()))
def q_feature_selection(spark, sf):
    """Model inputs by type, with what their rows hold; target, leakage and denied columns are left out"""
    from ..operators.models import select_feature_columns
    raw = inputs.raw(spark, sf).select("adr", "babies", "children", "lead_time", "adults", "hotel", "meal", "country", "is_canceled", "reservation_status",
                                       "arrival_date", "agent")
    numbers, categories = select_feature_columns(raw, deny=("agent",))
    pairs = ", ".join(f"'{c}', '{kind}', CAST(`{c}` AS STRING)" for kind, cols in (("number", numbers), ("category", categories)) for c in cols)
    long = raw.selectExpr(f"stack({len(numbers) + len(categories)}, {pairs}) as (column, kind, value)")
    values = long.groupBy("column", "kind", "value").agg(F.count("value").alias("n"))
    return values.groupBy("column", "kind").agg(F.sum("n").alias("known"), F.count("value").alias("different"))
