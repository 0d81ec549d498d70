"""Booking view derived from the order tables.

The given tables are order-shaped (orders, customer, nation, lineitem). One
order is one booking; every booking attribute is a deterministic function of
the order, its customer, the customer's nation and the order's line summary.

Plan shape at scale: ``lineitem`` is reduced to one row per order with a
partial (map-side) aggregate before it is shuffled; ``orders`` is joined to it
on the order key (the aggregate is already hash-partitioned on that key, so
only ``orders`` moves); the result is joined to ``customer`` on the customer key
(sort-merge, AQE splits a hot customer); ``nation`` has 25 rows by definition of
the schema and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_binary

# Split cutoffs on the booking creation date (parameters of the engine).
TRAIN_CUTOFF = "1999-06-30"
VALID_CUTOFF = "2000-06-30"


_TABLES: dict[tuple[int, str], tuple[int, DataFrame]] = {}


def table_stamp(spark: SparkSession, sf_dir: str, name: str) -> int:
    """When the table's file or folder last changed (one metadata call)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the given folder; the file listing is reused within a session until the
    table changes."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key, stamp = (id(spark._jsparkSession), path), table_stamp(spark, sf_dir, name)
    if _TABLES.get(key, (None,))[0] != stamp:
        _TABLES[key] = (stamp, spark.read.parquet(path))
    return _TABLES[key][1]


def _int(c: Column) -> Column:
    return c.cast("int")


def line_summary(lineitem: DataFrame) -> DataFrame:
    """One row per order: number of lines and of returned lines."""
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"),
    )


def split_label(created: Column, train_cutoff: str = TRAIN_CUTOFF, valid_cutoff: str = VALID_CUTOFF) -> Column:
    """Train / valid / test from two cutoffs on the creation date."""
    return (
        F.when(created <= F.lit(train_cutoff).cast("date"), "train")
        .when(created <= F.lit(valid_cutoff).cast("date"), "valid")
        .otherwise("test")
    )


def booking_view(spark: SparkSession, sf_dir: str, train_cutoff: str = TRAIN_CUTOFF,
                 valid_cutoff: str = VALID_CUTOFF) -> DataFrame:
    """Raw booking table (28 columns), one row per order."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = line_summary(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"))

    ok = F.col("o_orderkey")
    ck = F.col("o_custkey")
    seg = F.col("c_mktsegment")
    lead = _int((ok * 37) % 401)
    created = F.col("o_orderdate").cast("date")

    joined = (
        orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")
        # nation: fixed 25-row dimension, size bounded by the schema itself
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "inner")
    )
    n_ret = F.coalesce(F.col("n_ret"), F.lit(0))
    out = joined.select(
        ok.alias("booking_id"),
        F.when(ok % 3 == 0, "Resort Hotel").otherwise("City Hotel").alias("hotel"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_canceled"),
        F.when(F.col("o_orderstatus") != "F", "Check-Out")
        .when(ok % 40 == 0, "No-Show").otherwise("Canceled").alias("reservation_status"),
        lead.alias("lead_time"),
        created.alias("booking_creation_date"),
        F.date_add(created, lead).alias("arrival_date"),
        _int((ok * 5) % 3).alias("stays_in_weekend_nights"),
        _int((ok * 11) % 6).alias("stays_in_week_nights"),
        _int((ok * 13) % 4).alias("adults"),
        F.when(ok % 251 == 0, F.lit(None).cast("int")).otherwise(_int((ok * 17) % 3)).alias("children"),
        _int(F.when(ok % 50 == 0, 1).otherwise(0)).alias("babies"),
        F.element_at(F.array(*[F.lit(x) for x in ("BB", "HB", "SC", "FB")]), _int(ok % 4) + 1).alias("meal"),
        F.when(ok % 101 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("country"),
        F.when(seg == "MACHINERY", "Online TA").when(seg == "AUTOMOBILE", "Groups")
        .when(seg == "BUILDING", "Direct").when(seg == "HOUSEHOLD", "Corporate")
        .otherwise("Offline TA/TO").alias("market_segment"),
        F.when(seg == "BUILDING", "Direct").when(seg == "HOUSEHOLD", "Corporate")
        .otherwise("TA/TO").alias("distribution_channel"),
        _int(F.when(ck % 10 == 0, 1).otherwise(0)).alias("is_repeated_guest"),
        _int(F.when(n_ret > 3, F.col("n_ret") - 3).otherwise(0)).alias("previous_cancellations"),
        _int(ck % 5).alias("previous_bookings_not_canceled"),
        F.element_at(F.array(*[F.lit(x) for x in ("A", "D", "E", "F", "G")]), _int(ok % 5) + 1)
        .alias("reserved_room_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Non Refund")
        .when(F.col("o_orderpriority") == "2-HIGH", "Refundable").otherwise("No Deposit").alias("deposit_type"),
        F.when(F.col("o_orderstatus") == "P", "Transient-Party").otherwise("Transient").alias("customer_type"),
        F.when(ck % 7 == 0, F.lit(None).cast("string")).otherwise((ck % 97).cast("string")).alias("agent"),
        F.when(ck % 17 == 0, (ck % 31).cast("string")).otherwise(F.lit(None).cast("string")).alias("company_raw"),
        round_binary(F.col("o_totalprice") / 1000.0, 2).alias("adr"),
        _int(F.when(ok % 9 == 0, 1).otherwise(0)).alias("required_car_parking_spaces"),
        _int(F.coalesce(F.col("n_lines"), F.lit(0)) % 4).alias("total_of_special_requests"),
    )
    return out.withColumn("split", split_label(F.col("booking_creation_date"), train_cutoff, valid_cutoff))


def second_source(bookings: DataFrame) -> DataFrame:
    """P15 input: the booking view re-expressed with the second public source's 19 column names.

    ``booking_id`` becomes text with an ``INN`` prefix, ``arrival_date`` is the
    day of month, the status is a text label. Every booking is carried over.
    """
    return bookings.select(
        F.concat(F.lit("INN"), F.col("booking_id").cast("string")).alias("Booking_ID"),
        F.col("adults").cast("long").alias("no_of_adults"),
        F.coalesce(F.col("children"), F.lit(0)).cast("long").alias("no_of_children"),
        F.col("stays_in_weekend_nights").cast("long").alias("no_of_weekend_nights"),
        F.col("stays_in_week_nights").cast("long").alias("no_of_week_nights"),
        F.col("meal").alias("type_of_meal_plan"),
        F.col("required_car_parking_spaces").cast("long").alias("required_car_parking_space"),
        F.col("reserved_room_type").alias("room_type_reserved"),
        F.col("lead_time").cast("long").alias("lead_time"),
        F.year("arrival_date").cast("long").alias("arrival_year"),
        F.month("arrival_date").cast("long").alias("arrival_month"),
        F.dayofmonth("arrival_date").cast("long").alias("arrival_date"),
        F.col("market_segment").alias("market_segment_type"),
        F.col("is_repeated_guest").cast("long").alias("repeated_guest"),
        F.col("previous_cancellations").cast("long").alias("no_of_previous_cancellations"),
        F.col("previous_bookings_not_canceled").cast("long").alias("no_of_previous_bookings_not_canceled"),
        F.col("adr").alias("avg_price_per_room"),
        F.col("total_of_special_requests").cast("long").alias("no_of_special_requests"),
        F.when(F.col("is_canceled") == 1, "Canceled").otherwise("Not_Canceled").alias("booking_status"),
    )
