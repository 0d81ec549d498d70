"""Feature preparation (P8-P13, D1-D7, N1-N13): one narrow projection, no shuffle.

``prepare_features`` is a chain of four ``withColumns`` stages (coercion, dates,
derived features, sanitiser) rather than ~50 ``withColumn`` calls, so the
analyzed plan stays small and the whole thing is one whole-stage-codegen span
on top of the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    clip, cyclic, date_from_parts, finite0, flag, floor0, month_name_from_num, month_num_from_name,
    num0, quarter_from_month, season, to_double, unknown_if_missing, weekday_monday0,
)
from ..functions.constants import (
    CATEGORICAL_FEATURES, FEATURE_COLUMNS, NUMERIC_FEATURES, REQUIRED_COLUMNS, TARGET_ENCODING_OUTPUT_FEATURES,
)
from .ordered import global_order
from .schema import calendar_date, day_number, drop_leakage, ensure_columns, normalize_input_schema, require_complete

FLOORED = [
    "lead_time", "adr", "stays_in_weekend_nights", "stays_in_week_nights", "required_car_parking_spaces",
    "total_of_special_requests", "previous_cancellations", "previous_bookings_not_canceled",
]


def prepare_features(df: DataFrame, strict: bool = False, keep: tuple[str, ...] = (), ids_complete: bool = False) -> DataFrame:
    """Raw bookings (any column names) -> prepared bookings with the model features.

    ``keep`` names extra input columns to carry through (e.g. ``is_canceled``, ``split``).
    ``ids_complete`` says that no id is NULL (a table's key): the plan then stays free of the
    row numbering that NULL ids need, and filters can pass it.
    """
    out, mapping = normalize_input_schema(df)
    if strict:
        require_complete(mapping)
    out = drop_leakage(out)
    out = ensure_columns(out, REQUIRED_COLUMNS + ["country", "arrival_date_week_number", "booking_id", "agent",
                                                  "company_raw"])
    if "booking_id" not in mapping.mapped:
        from .ordered import with_row_index
        out = with_row_index(out.drop("booking_id"), "booking_id")
    elif not ids_complete:
        out = _with_ids(out)

    has_company_given = "has_company" in out.columns
    has_date = "arrival_date" in out.columns
    date_type = out.schema["arrival_date"].dataType if has_date else None
    arrival_src = calendar_date(F.col("arrival_date"), date_type) if has_date else None
    is_day = day_number(F.col("arrival_date"), date_type).isNotNull() if has_date else None
    given_num = F.coalesce(to_double("arrival_month_num"), to_double(month_num_from_name(F.col("arrival_date_month")))) \
        if "arrival_month_num" in out.columns else to_double(month_num_from_name(F.col("arrival_date_month")))

    # stage 1: coercion, missing flags taken before the fill
    s1 = {
        "children": num0("children"),
        "babies": num0("babies"),
        "adults": num0("adults"),
        **{c: floor0(c) for c in FLOORED},
        "is_repeated_guest": clip(num0("is_repeated_guest"), 0.0, 1.0),
        "country_missing": F.col("country").isNull().cast("int"),
        "country": unknown_if_missing("country"),
        "agent_missing": F.col("agent").isNull().cast("int"),
        "agent": unknown_if_missing("agent"),
        "company_raw": unknown_if_missing("company_raw"),
        "arrival_month_num": clip(F.coalesce(given_num, F.lit(1.0)), 1.0, 12.0),
    }
    out = out.withColumns(s1)
    derived_company = (F.lower(F.col("company_raw")) != "unknown").cast("int")
    if has_company_given:
        hc = to_double("has_company")
        out = out.withColumn("has_company", F.coalesce(clip(hc, 0.0, 1.0), derived_company.cast("double")))
    else:
        out = out.withColumn("has_company", derived_company)

    # stage 2: calendar
    from_parts = date_from_parts(
        F.coalesce(to_double("arrival_date_year"), F.lit(2017.0)),
        F.col("arrival_month_num"),
        clip(F.coalesce(to_double("arrival_date_day_of_month"), F.lit(1.0)), 1.0, 28.0),
    )
    # a value that is only a day of the month is completed from the other parts
    arrival = F.when(is_day, from_parts).otherwise(arrival_src) if has_date else from_parts
    out = out.withColumn("arrival_date", arrival)
    d = F.col("arrival_date")
    mnum = F.col("arrival_month_num")
    out = out.withColumns({
        "arrival_date_month": F.coalesce(F.col("arrival_date_month").cast("string"),
                                         month_name_from_num(mnum), F.lit("Unknown")),
        "arrival_date_year": F.coalesce(to_double("arrival_date_year"), F.year(d).cast("double"), F.lit(2017.0)),
        "arrival_date_week_number": F.coalesce(to_double("arrival_date_week_number"),
                                               F.weekofyear(d).cast("double"), F.lit(1.0)),
        "arrival_date_day_of_month": F.coalesce(to_double("arrival_date_day_of_month"),
                                                F.dayofmonth(d).cast("double"), F.lit(1.0)),
        "arrival_season": season(mnum),
    })

    # stage 3: derived features
    we, wk = F.col("stays_in_weekend_nights"), F.col("stays_in_week_nights")
    tn = we + wk
    total_nights = F.when(tn <= 0, F.lit(1.0)).otherwise(tn)
    tg = F.col("adults") + F.col("children") + F.col("babies")
    total_guests = F.when(tg <= 0, F.lit(1.0)).otherwise(tg)
    out = out.withColumns({"total_nights": total_nights, "total_guests": total_guests})
    out = out.withColumn("booking_value", F.col("adr") * F.col("total_nights"))
    lead, adr, value = F.col("lead_time"), F.col("adr"), F.col("booking_value")
    req, park = F.col("total_of_special_requests"), F.col("required_car_parking_spaces")
    ch, bb, ad = F.col("children"), F.col("babies"), F.col("adults")
    msin, mcos = cyclic(mnum, 12)
    wsin, wcos = cyclic(F.col("arrival_date_week_number"), 53)
    dow = weekday_monday0(d)
    out = out.withColumns({
        "has_children": flag((ch + bb) > 0),
        "has_previous_cancellations": flag(F.col("previous_cancellations") > 0),
        "has_special_requests": flag(req > 0),
        "is_long_lead_booking": flag(lead > 90),
        "is_weekend_stay": flag(we > 0),
        "arrival_quarter": quarter_from_month(mnum),
        "arrival_dayofweek": dow,
        "arrival_is_weekend": flag(dow.isin(5, 6)),
        "month_sin": msin, "month_cos": mcos, "week_sin": wsin, "week_cos": wcos,
        "weekend_share": we / F.greatest(F.col("total_nights"), F.lit(1.0)),
        "adr_per_guest": adr / F.greatest(F.col("total_guests"), F.lit(1.0)),
        "lead_time_x_value": lead * F.log1p(F.greatest(value, F.lit(0.0))),
        "lead_time_x_requests": lead * (F.lit(1.0) + req),
        "lead_time_log": F.log1p(F.greatest(lead, F.lit(0.0))),
        "adr_log": F.log1p(F.greatest(adr, F.lit(0.0))),
        "value_per_night_log": F.log1p(F.greatest(value / F.greatest(F.col("total_nights"), F.lit(1.0)), F.lit(0.0))),
        "is_single_adult": flag((ad == 1) & (ch == 0) & (bb == 0)),
        "is_family": flag((ad >= 1) & ((ch + bb) > 0)),
        "has_parking_request": flag(park > 0),
        "no_special_no_parking": flag((req == 0) & (park == 0)),
        **{c: F.lit(0.0) for c in TARGET_ENCODING_OUTPUT_FEATURES if c not in out.columns},
    })

    # stage 4: categorical fill + numeric sanitiser
    out = out.withColumns({
        **{c: unknown_if_missing(c, ("nan", "None")) for c in CATEGORICAL_FEATURES},
        **{c: finite0(c) for c in NUMERIC_FEATURES},
    })
    extra = [c for c in keep if c in out.columns and c not in FEATURE_COLUMNS]
    return out.select("booking_id", "arrival_date", *FEATURE_COLUMNS, *extra)


#: Copies of one row that one task numbers.
COPIES = 100_000


def _with_ids(df: DataFrame) -> DataFrame:
    """Ids as given; a row whose id is NULL gets one that follows from its content, however the rows are split.

    Text: ``row-<digest>-<k>``, the k-th of the equal rows, counting on from given ids of that form. Numbers: below 0 and
    below every given id, in the order of digest and k. Equal rows are counted first, so a row that most
    rows repeat is one row until its copies are numbered.
    """
    dtype, others = df.schema["booking_id"].dataType, [c for c in df.columns if c != "booking_id"]
    digest = F.sha2(F.to_json(F.struct(*others)), 256)
    none = df.where(F.col("booking_id").isNull()).select(digest.alias("_digest"), F.struct(*others).alias("_row"))
    some = none.groupBy("_digest").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    parts = some.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES)))).repartition("_digest", "_part")
    first = F.col("_part") * COPIES + 1
    rows = parts.withColumn("_k", F.explode(F.sequence(first, F.least(F.col("_n"), first + (COPIES - 1)))))
    given = df.where(F.col("booking_id").isNotNull())
    if isinstance(dtype, T.NumericType):
        least = given.agg(F.coalesce(F.least(F.min(F.col("booking_id").cast("long")), F.lit(0)), F.lit(0)).cast("long").alias("_least"))  # one row
        ranked = global_order(rows.select("_digest", "_row", "_k"), [F.asc("_digest"), F.asc("_k")], "_rank")
        made = ranked.crossJoin(F.broadcast(least)).select((F.col("_least") - F.col("_rank")).alias("booking_id"), "_row.*")
        return given.withColumn("booking_id", F.col("booking_id").cast("long")).unionByName(made)
    own = F.col("booking_id").cast("string")
    taken = given.where(own.rlike("^row-[0-9a-f]{64}-[0-9]+$")).groupBy(F.substring(own, 5, 64).alias("_digest")).agg(
        F.max(F.substring_index(own, "-", -1).try_cast("long")).alias("_taken"))
    made = rows.join(taken, "_digest", "left").select(
        F.concat(F.lit("row-"), F.col("_digest"), F.lit("-"), (F.col("_k") + F.coalesce("_taken", F.lit(0))).cast("string")).alias("booking_id"), "_row.*")
    return given.withColumn("booking_id", own).unionByName(made)


def model_matrix(df: DataFrame) -> DataFrame:
    """The model's input columns."""
    return df.select(*FEATURE_COLUMNS)
