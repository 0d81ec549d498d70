"""Ranking, top-k and prefix operators.

Small top-k (k bounded by a constant: 10, 15, 20) is ``orderBy().limit(k)``,
which Spark plans as TakeOrderedAndProject: each task keeps only k rows.
Sums of a top share and the best prefix count cells of values and order rows only
in the cells that hold a cut (``select``); row numbers that every row needs (equal-count
bins, 70/15/15 split) use the distributed ``global_order`` instead of a single-partition window. Every ordering ends with ``booking_id`` so ties are
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import date_from_parts, month_num_from_name, normalize_month, to_double
from ..functions.constants import SPLIT_TRAIN_CUTOFF, SPLIT_VALID_CUTOFF
from ..sources.bookings import split_label
from .filters import hash_bucket
from .ordered import global_order
from .schema import calendar_date
from .select import best_prefix, exact_quantiles, top_sums

KEY = "booking_id"


def priority_order(df: DataFrame, col: str = "business_priority_score") -> list[Column]:
    """O1: priority descending (NULL last), then id."""
    return [F.desc_nulls_last(col), F.asc(KEY)]


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Bounded top-n (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(int(n))


def economics(df: DataFrame, shares=(0.1, 0.2, 0.3), success_rate: float = 0.25,
              cost_per_action: float = 150.0, rounding: str = "floor") -> DataFrame:
    """A26 + O3: intervention economics of the top share by priority, one row per scenario.

    n_sel = max(1, int(n*share)); loss of the selected rows, protected = loss*rate,
    cost = n_sel*cost, net. Empty input gives zeros.
    """
    rows = df.select(KEY, "business_priority_score", "expected_loss", "deposit_type").checkpoint(eager=True)  # narrow, read by each pass
    measures = {"_loss": F.col("expected_loss"), "_nd": (F.col("deposit_type") == "No Deposit").cast("double"),
                "_nr": (F.col("deposit_type") == "Non Refund").cast("double")}
    whole = F.floor if rounding == "floor" else F.ceil
    top = top_sums(rows, [], "business_priority_score", KEY, measures,
                   [(s, F.greatest(F.lit(1).cast("long"), whole(F.col("_size") * F.lit(float(s))).cast("long"))) for s in shares])
    names = df.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "_t int, top_share double")
    k, loss = F.coalesce("_k", F.lit(0)), F.coalesce("_loss", F.lit(0.0))
    return names.join(top, "_t", "left").select(
        "top_share", k.cast("double").alias("selected_bookings"), loss.alias("expected_loss"), (loss * F.lit(success_rate)).alias("gross_protected_revenue"),
        (k * F.lit(cost_per_action)).cast("double").alias("intervention_cost"), (loss * F.lit(success_rate) - k * F.lit(cost_per_action)).alias("net_effect"),
        F.try_divide("_nd", "_k").alias("share_no_deposit"), F.try_divide("_nr", "_k").alias("share_non_refund"))


def prefix_optimum(df: DataFrame, success_rate: float = 0.25, cost_per_action: float = 150.0,
                   score: str = "business_priority_score", only: str | None = None) -> DataFrame:
    """The priority prefix with the best net = cum_loss*rate - k*cost; zeros if none gains.

    Ties of the net keep the smallest k. ``only``: a boolean column of the rows that count (a filter above this
    operator would be pushed below the columns it is derived from, and derive them again). One summary row.
    """
    rows = df.select(KEY, score, "expected_loss", *([only] if only else [])).checkpoint(eager=True)  # narrow, read by each pass
    rows = rows.where(F.col(only)) if only else rows
    rows = rows.withColumn("_loss", F.greatest(F.coalesce(F.col("expected_loss").cast("double"), F.lit(0.0)), F.lit(0.0)))
    best = best_prefix(rows, score, KEY, F.col("_loss") * F.lit(success_rate) - F.lit(cost_per_action), {"cum_loss": F.col("_loss")})
    best = best.where("net > 0").agg(F.max("k").alias("k"), F.max("cum_loss").alias("cum_loss"))  # one row, also where none gains
    k, cum = F.coalesce("k", F.lit(0)), F.coalesce("cum_loss", F.lit(0.0))
    protected, cost = cum * F.lit(success_rate), (k * F.lit(cost_per_action)).cast("double")
    return best.select(k.cast("double").alias("review_count"), cum.alias("review_expected_loss"), protected.alias("protected"),
                       cost.alias("cost"), (protected - cost).alias("net"))


def equal_count_bins(df: DataFrame, value: str, q: int = 5, out: str = "bin", keep: list[str] | None = None) -> DataFrame:
    """``qcut(rank(method='first'), q)`` = greatest(1, ceil((rn-1)*q/(n-1))). Returns the id, the
    value, the bin and the columns of ``keep``."""
    ranked = global_order(df.select(KEY, *dict.fromkeys([value, *(keep or [])])), [F.asc_nulls_last(value), F.asc(KEY)], "_rn", size_col="_n")
    b = F.when(F.col("_n") <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil((F.col("_rn") - 1) * F.lit(q) / (F.col("_n") - 1)).cast("int")))
    return ranked.withColumn(out, b).drop("_rn", "_n")


def quantile_edge_bins(df: DataFrame, value: Column, q: int = 5, out: str = "bin") -> DataFrame:
    """``qcut(value, q, duplicates='drop')``: exact quantile edges, duplicate edges dropped,
    right-closed bins, the first bin includes the minimum. Output: bin ordinal (1-based), edges."""
    probs = [i / q for i in range(q + 1)]
    tmp = df.withColumn("_val", value)
    edges = exact_quantiles(tmp, "_val", probs, KEY)
    arr = edges.agg(F.array_distinct(F.array_sort(F.collect_list("q"))).alias("_edges"))  # q+1 values
    j = tmp.crossJoin(F.broadcast(arr))
    n_lower = F.size(F.filter(F.col("_edges"), lambda e: e < F.col("_val")))
    b = F.when(F.col("_val").isNull(), F.lit(None)).otherwise(F.greatest(F.lit(1), n_lower))
    j = j.withColumn(out, b.cast("int"))
    return j.withColumns({f"{out}_lower": F.element_at("_edges", F.col(out)),
                          f"{out}_upper": F.element_at("_edges", F.col(out) + 1)}).drop("_edges", "_val")


def creation_date(df: DataFrame, created_col: str = "booking_creation_date") -> Column:
    """D3: the creation date as given, else arrival minus lead time, the arrival itself from the date
    or, where that is unknown, from its parts. NULL where nothing tells it."""
    arrival = F.lit(None).cast("date")
    if {"arrival_date_year", "arrival_date_month", "arrival_date_day_of_month"} <= set(df.columns):
        month = normalize_month(F.col("arrival_date_month"), df.schema["arrival_date_month"].dataType)
        arrival = date_from_parts(to_double("arrival_date_year"), month_num_from_name(month), to_double("arrival_date_day_of_month"))
    if "arrival_date" in df.columns:
        arrival = F.coalesce(calendar_date(F.col("arrival_date"), df.schema["arrival_date"].dataType), arrival)
    out = F.date_sub(arrival, to_double("lead_time").cast("int")) if "lead_time" in df.columns else F.lit(None).cast("date")
    if created_col in df.columns:
        out = F.coalesce(calendar_date(F.col(created_col), df.schema[created_col].dataType), out)
    return out


def assign_split(df: DataFrame, created_col: str = "booking_creation_date", train_cutoff: str = SPLIT_TRAIN_CUTOFF,
                 valid_cutoff: str = SPLIT_VALID_CUTOFF) -> tuple[DataFrame, str]:
    """D8 + D10 + W7: the split strategy of training.

    An existing ``split`` column wins. Otherwise cutoffs on the (given or derived) creation
    date are used when *every* creation date is known (one aggregate decides the branch on
    the driver); else the 70/15/15 chronological fallback.
    """
    if "split" in df.columns:
        return df, "existing_split_column"
    created = creation_date(df, created_col)
    if df.agg(F.bool_and(created.isNotNull()).alias("ok")).first()["ok"]:
        return df.withColumn("split", split_label(created, train_cutoff, valid_cutoff)), "booking_creation_date"
    return chronological_split(df).withColumnRenamed("chrono_split", "split"), "arrival_date_fallback"


def random_split(df: DataFrame, seed: int = 42, test_pct: int = 20, valid_pct: int = 20) -> DataFrame:
    """U4: hash-bucket split when a split is empty: test = test_pct % of rows, valid =
    valid_pct % of the remainder; depends only on the id and the seed."""
    b = hash_bucket(F.col(KEY), seed)
    rest = hash_bucket(F.col(KEY), seed + 1)
    return df.withColumn("split", F.when(b < test_pct, "test").when(rest < valid_pct, "valid").otherwise("train"))


def fill_empty_splits(df: DataFrame, sizes: dict[str, int], seed: int = 42, valid_pct: int = 20) -> tuple[DataFrame, bool]:
    """U4: a missing test split is drawn from all rows anew; a missing validation split only from
    train, so that a test split that exists is never trained on. Says whether rows were moved."""
    if not sizes.get("test"):
        return random_split(df.drop("split"), seed, valid_pct=valid_pct), True
    if not sizes.get("valid"):
        moved = (F.col("split") == "train") & (hash_bucket(F.col(KEY), seed + 1) < valid_pct)
        return df.withColumn("split", F.when(moved, "valid").otherwise(F.col("split"))), True
    return df, False


def chronological_split(df: DataFrame, date_col: str = "arrival_date", train: float = 0.70,
                        valid: float = 0.85, keep: list[str] | None = None) -> DataFrame:
    """W7 + P26: 70/15/15 by position in (date, id) order, of the rows with a date."""
    known = df.where(F.col(date_col).isNotNull())  # P26: rows without a date are in no split
    known = known.select(KEY, date_col, *(c for c in (keep if keep is not None else df.columns) if c not in (KEY, date_col)))
    ranked = global_order(known, [F.asc(date_col), F.asc(KEY)], "_pos", size_col="_n")
    c1, c2 = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(valid))
    label = F.when(F.col("_pos") <= c1, "train").when(F.col("_pos") <= c2, "valid").otherwise("test")
    return ranked.withColumn("chrono_split", label).drop("_pos", "_n")
