"""Aggregations over bookings and predictions.

Every group-by here is a hash aggregate with partial (map-side) aggregation,
so a hot key — one segment holding a third of all rows — is pre-combined in
each task before the shuffle and never lands as raw rows in one task. Group
keys are low-cardinality labels; NULL keys are kept as their own group unless
the operator says otherwise. Shares of the total (J7 / W5) join a one-row total
computed from the *aggregated* table, so the input is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .select import exact_quantiles


def group_loss(pred: DataFrame, group: str, with_risk: bool = True, top: int | None = None,
               prob_col: str = "cancellation_probability") -> DataFrame:
    """Count (non-null ids), expected loss and mean risk per group, optional top-N by loss."""
    aggs = [F.count("booking_id").alias("count"), F.sum("expected_loss").alias("expected_loss")]
    if with_risk:
        aggs.append(F.avg(prob_col).alias("avg_risk"))
    out = pred.groupBy(group).agg(*aggs)
    if top:
        out = out.orderBy(F.desc("expected_loss"), F.asc(group)).limit(top)
    return out


def with_share(grouped: DataFrame, count_col: str = "count", out: str = "share_of_rows") -> DataFrame:
    """Share of the total, the total taken from the aggregated table (one row, broadcast)."""
    total = grouped.agg(F.sum(count_col).alias("_total"))
    return grouped.crossJoin(F.broadcast(total)).withColumn(out, F.col(count_col) / F.col("_total")).drop("_total")


def rate_table(df: DataFrame, group: Column | str, target: str = "is_canceled", min_count: int = 1) -> DataFrame:
    """A1: count, cancellations, rate and share of rows per group (NULL group kept), min-count filter."""
    g = F.col(group) if isinstance(group, str) else group
    out = df.groupBy(g).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col(target).cast("long")).alias("cancellations"),
        F.avg(F.col(target).cast("double")).alias("cancel_rate"))
    return with_share(out).where(F.col("count") >= min_count)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A13"""
    return with_share(df.groupBy(col).agg(F.count(F.lit(1)).alias("count")), out="share")


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One aggregate of per-column NULL counts, turned into a long table with ``stack``."""
    cols = columns or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', _m{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("_rows", f"stack({len(cols)}, {pairs}) as (column, missing)")
    return long.select("column", "missing", F.coalesce(F.try_divide("missing", "_rows"), F.lit(0.0)).alias("missing_share"))


def column_profile(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Missing count / rate and the number of distinct values counting NULL as one value.

    Exact: the cells in long form, made distinct with partial aggregation before the shuffle, so
    a column of few values costs a few rows per task. ``approx`` counts all columns in one pass
    with sketches of bounded size (relative error about 2 %).
    """
    cols = columns or df.columns
    types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in cols], "column string, dtype string")
    if approx:
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[x for i, c in enumerate(cols) for x in (
            F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}"), F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"_u{i}"))])
        pairs = ", ".join(f"'{c}', _m{i}, _u{i} + cast(_m{i} > 0 as int)" for i, c in enumerate(cols))
        counts = wide.selectExpr("_rows", f"stack({len(cols)}, {pairs}) as (column, missing, n_unique)")
    else:
        pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
        cells = df.selectExpr(f"stack({len(cols)}, {pairs}) as (column, value)").groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
        counts = cells.groupBy("column").agg(
            F.sum("_n").alias("_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("missing"),
            F.count(F.lit(1)).alias("n_unique"))
    out = types.join(counts, "column", "left")  # an empty table still lists its columns
    zero = F.lit(0).cast("long")
    return out.select("column", "dtype", F.coalesce("missing", zero).cast("long").alias("missing"),
                      F.coalesce(F.try_divide("missing", "_rows"), F.lit(0.0)).alias("missing_rate"),
                      F.coalesce("n_unique", zero).cast("long").alias("n_unique"))


def describe(df: DataFrame, columns: list[str], key: str, percentiles=(0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean, sample std, min, exact percentiles, max per column (long form).

    The columns are written once, side by side, and unpivoted to (column, value) where they are read;
    percentiles come from cells of values, of which only those that hold one are ordered.
    """
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).checkpoint(eager=True)
    long = wide.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)")
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(long, "value", list(percentiles), partition_by=["column"], written=True)
    names = [f"p{int(round(p * 100)):02d}" for p in percentiles]
    wide_q = qs.groupBy("column").agg(*[F.max(F.when(F.col("_i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])
    return stats.join(wide_q, "column", "left")  # a column without values has no percentiles


def quality_checks(raw: DataFrame) -> DataFrame:
    """Named data-quality predicates, count and share, in one pass."""
    from ..functions.constants import QUALITY_CHECK_NAMES
    guests = F.col("adults") + F.col("children") + F.col("babies")
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    preds = [F.col("arrival_date").isNull(), guests == 0, nights == 0, F.col("adr") < 0,
             F.col("lead_time") < 0, F.col("adr") * nights < 0]
    wide = raw.agg(F.count(F.lit(1)).alias("_rows"),
                   *[F.count_if(F.coalesce(p, F.lit(False))).alias(f"_c{i}") for i, p in enumerate(preds)])
    pairs = ", ".join(f"'{n}', _c{i}" for i, n in enumerate(QUALITY_CHECK_NAMES))
    long = wide.selectExpr("_rows", f"stack({len(preds)}, {pairs}) as (check, count)")
    return long.select("check", "count", F.coalesce(F.try_divide("count", "_rows"), F.lit(0.0)).alias("share"))


def sanity_filter(df: DataFrame) -> DataFrame:
    """Guests > 0, nights > 0, adr >= 0, arrival date present."""
    guests = F.col("adults") + F.coalesce(F.col("children"), F.lit(0)) + F.col("babies")
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    return df.where((guests > 0) & (nights > 0) & (F.col("adr") >= 0) & F.col("arrival_date").isNotNull())


def pivot_mean(df: DataFrame, index: str, columns: str, values: str, levels: list[str]) -> DataFrame:
    """Pivot of means with explicit levels (no extra job to discover them)."""
    return df.groupBy(index).pivot(columns, levels).agg(F.avg(F.col(values).cast("double")))


def crosstab_normalized(df: DataFrame, index: str, columns: str, levels: list[str]) -> DataFrame:
    """Counts per (index, level), zeros filled, divided by the row sum."""
    counts = df.groupBy(index).pivot(columns, levels).count().na.fill(0, levels)
    total = sum((F.col(f"`{lv}`") for lv in levels), F.lit(0))
    return counts.select(index, *[(F.col(f"`{lv}`") / total).alias(lv) for lv in levels])


def domain_complete_counts(df: DataFrame, source: str, bin_col: Column, bins: list[str]) -> DataFrame:
    """Every (source, bin) pair appears, empty bins with count 0.

    The domain is (distinct sources) x (the fixed bin labels): a small cross join of
    two small tables, left-joined to the aggregate.
    """
    counts = df.groupBy(F.col(source).alias("source"), bin_col.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    bins_df = spark.createDataFrame([(b, i) for i, b in enumerate(bins)], "bin string, bin_order int")
    sources = df.select(F.col(source).alias("source")).distinct()
    domain = sources.crossJoin(F.broadcast(bins_df))
    counts = counts.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), "count")
    return (domain.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")), "left")
            .select("source", "bin", "bin_order", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def share_within(df: DataFrame, keys: list[str], within: list[str], count_col: str = "count") -> DataFrame:
    """Counts per keys and their share inside the ``within`` group (join of group totals)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    totals = counts.groupBy(*within).agg(F.sum(count_col).alias("_t"))
    return counts.join(totals, within).withColumn("share_in_group", F.col(count_col) / F.col("_t")).drop("_t")


def segment_profile(df: DataFrame, dims: list[str], target: str = "is_canceled") -> DataFrame:
    """N, rate, mean adr, value sum for many dimensions in one pass.

    Each row is expanded to (dimension, value) pairs and partially aggregated in
    the same stage, so only (dimension x distinct value) partial rows are shuffled.
    """
    pairs = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in dims)
    long = df.selectExpr(target, "adr", "booking_value", f"stack({len(dims)}, {pairs}) as (dimension, value)")
    return long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(target).cast("double")).alias("cancel_rate"),
        F.avg("adr").alias("mean_adr"), F.sum("booking_value").alias("booking_value_sum"))


def filter_options(df: DataFrame, columns: list[str], severity_col: str = "risk_category") -> DataFrame:
    """Distinct non-null values per column, sorted; risk categories in severity order."""
    from ..functions.constants import RISK_SEVERITY_ORDER
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)").where(F.col("value").isNotNull())
    distinct = long.distinct()
    sev = F.array(*[F.lit(x) for x in RISK_SEVERITY_ORDER])
    pos = F.when((F.col("column") == severity_col) & (F.array_position(sev, F.col("value")) > 0),
                 F.array_position(sev, F.col("value"))).otherwise(F.lit(len(RISK_SEVERITY_ORDER) + 1))
    return distinct.withColumn("severity_rank", pos.cast("int"))


def class_weights(df: DataFrame, label: str = "is_canceled") -> DataFrame:
    """A33: 'balanced' weights n / (n_classes * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(tot)).select(
        label, "count", (F.col("_n") / (F.col("_k") * F.col("count"))).alias("weight"))


def leakage_audit(df: DataFrame, leakage: list[str], target: str = "is_canceled") -> DataFrame:
    """Profile joined with a literal decision table."""
    prof = column_profile(df)
    spark = df.sparkSession
    decisions = spark.createDataFrame(
        [(c, "drop: post-factum") for c in leakage] + [(target, "target")],
        T.StructType([T.StructField("column", T.StringType()), T.StructField("decision", T.StringType())]))
    return (prof.join(F.broadcast(decisions), "column", "left")
            .select("column", "n_unique", F.col("missing_rate").alias("missing_share"),
                    F.coalesce("decision", F.lit("keep")).alias("decision")))
