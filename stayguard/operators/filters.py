"""Row filters and reproducible sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_hash(key: Column, seed: int) -> Column:
    """60 bits of the md5 of seed and id as text: any type of id, any SQL engine can repeat it, draws
    of different seeds are independent, and partitioning does not matter."""
    text = F.concat(F.lit(f"{int(seed)}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hash_bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    """U4: bucket 0..buckets-1 of an id."""
    return id_hash(key, seed) % buckets


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "booking_id") -> DataFrame:
    """At most ``n`` rows, the same rows on every run (bounded top-n by hash)."""
    return df.orderBy(id_hash(F.col(key), seed), F.col(key)).limit(int(n))


def multi_filter(df: DataFrame, hotels=(), segments=(), channels=(), categories=(), min_loss: float = 0.0) -> DataFrame:
    """Multi-select filters; an empty selection means no filter on that column."""
    out = df
    for col, values in (("hotel", hotels), ("market_segment", segments), ("distribution_channel", channels),
                        ("risk_category", categories)):
        if values:
            out = out.where(F.col(col).cast("string").isin(list(values)))
    if min_loss > 0:
        out = out.where(F.coalesce(F.col("expected_loss").try_cast("double"), F.lit(0.0)) >= float(min_loss))
    return out


def category_filter(df: DataFrame, category: str | None) -> DataFrame:
    """P18"""
    return df if not category else df.where(F.col("risk_category") == category)


def arrival_horizon(df: DataFrame, days: int, date_col: str = "arrival_date") -> DataFrame:
    """P20: arrivals within ``days`` of the earliest arrival of the whole table.

    The earliest date is a one-row aggregate, broadcast to every task (J7).
    """
    base = df.agg(F.min(date_col).alias("_base"))
    j = df.crossJoin(F.broadcast(base))
    d = F.col(date_col)
    return j.where(d.isNotNull() & (d >= F.col("_base")) & (d <= F.date_add("_base", int(days)))).drop("_base")


def lookup(df: DataFrame, booking_id) -> DataFrame:
    """P24"""
    return df.where(F.col("booking_id") == F.lit(booking_id))


def check_row_limit(df: DataFrame, max_rows: int) -> int:
    """Input expectation (not empty, at most ``max_rows``) with a bounded count.

    ``limit(max+1).count()`` stops reading once the limit is exceeded.
    """
    n = df.limit(int(max_rows) + 1).count() if max_rows < 2 ** 31 - 1 else df.count()  # Spark's limit is an int
    if n == 0:
        raise ValueError("empty input")
    if n > max_rows:
        raise ValueError(f"input has more than {max_rows} rows")
    return n
