"""Train-only target / frequency encoding.

``fit`` runs on the training rows only and returns a long statistics table
``(column, key, n, smooth_mean)`` plus a one-row prior; ``transform`` looks
the keys up with left joins and falls back to the prior (target mean) or 0
(frequency) for unseen keys. Fit and transform are separate functions, so the
validation and test rows can never leak into the statistics.

Lookup tables are as large as the number of distinct keys, and a row is looked up in many of
them. ``lookup_columns`` broadcasts the columns of few keys; the columns of many are done in one join: the distinct
key tuples are unpivoted to (tuple, column, key), joined once and pivoted back, and the rows meet their tuple in a single shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unknown_if_missing
from ..functions.constants import ENCODER_DEFAULT_PRIOR, ENCODER_SMOOTHING, TARGET_ENCODED_COLUMNS
from .select import HELD, exact_quantiles

#: A key is hot in its column if it holds one part in so many of the counted rows: a column has at most this many.
HOT_PARTS = 1000


def lookup_columns(df: DataFrame, keys: dict[str, Column], table: DataFrame, payload: list[str], found: str = "_found") -> DataFrame:
    """``df`` with the struct ``found`` that holds, per name in ``keys``, the payload of its key (NULL if unseen).

    ``table``: (column, key, n, payload...), unique in (column, key); ``n``: the rows counted at the key; it is read for each
    name, so it should be written. A column of at most HELD keys is broadcast whole, so that the rows do not move. In the
    others hot keys, at most HOT_PARTS a column, are broadcast, so the shuffled join of the rest has no hot key, and
    key tuples that many rows share are looked up once. NULL keys are looked up as such and never found.
    """
    names = list(keys)
    some = table.where(F.col("column").isin(names)).select("column", "key", "n", *[c for c in payload if c != "n"])
    sizes = {r["column"]: r["count"] for r in some.groupBy("column").count().collect()}  # one row a column
    small = [c for c in names if sizes.get(c, 0) <= HELD]
    rows = df.withColumn("_keys", F.struct(*[keys[c].cast("string").alias(c) for c in names]))
    for i, c in enumerate(small):
        own = some.where((F.col("column") == c) & F.col("key").isNotNull()).select(F.col("key").alias(f"_key{i}"), F.struct(*payload).alias(f"_value{i}"))
        rows = rows.join(F.broadcast(own), F.col("_keys").getField(c) == F.col(f"_key{i}"), "left").drop(f"_key{i}")
    large = [c for c in names if c not in small]
    if large:
        rows = _lookup_large(rows, large, some, payload)
    of = {c: F.col(f"_value{i}") for i, c in enumerate(small)} | {c: F.col("_wide").getField(c) for c in large}
    return rows.withColumn(found, F.struct(*[of[c].alias(c) for c in names])).drop("_keys", "_wide", *[f"_value{i}" for i in range(len(small))])


def _lookup_large(rows: DataFrame, names: list[str], table: DataFrame, payload: list[str]) -> DataFrame:
    """``rows`` with the struct ``_wide`` of what is found in columns of many keys, by the keys in the struct ``_keys``."""
    rows = rows.withColumn("_large", F.struct(*[F.col("_keys").getField(c).alias(c) for c in names]))
    tuples = rows.select("_large").distinct()
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_large").getField(c).alias("key")) for c in names])
    long = tuples.select("_large", F.explode(pairs).alias("_p")).select("_large", "_p.*").where("key is not null")
    some = table.where(F.col("column").isin(names))
    total = some.groupBy("column").agg(F.sum("n").alias("_total"))  # one row a column
    some = some.join(F.broadcast(total), "column").withColumn("_hot", F.col("n") * HOT_PARTS >= F.col("_total"))
    value = F.struct(*payload).alias("_value")
    hot = F.broadcast(some.where("_hot").select("column", "key", value))
    cold = some.where("not _hot").select("column", "key", value)
    met = long.join(hot, ["column", "key"]).unionByName(long.join(hot, ["column", "key"], "left_anti").join(cold, ["column", "key"]))
    wide = met.groupBy("_large").agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("_value"))).alias(c) for c in names]).alias("_wide"))
    return rows.join(wide, "_large", "left").drop("_large")


@dataclass
class EncoderModel:
    stats: DataFrame   # column, key, n, smooth_mean
    prior: DataFrame   # one row: prior
    columns: list[str]
    smoothing: float


def fit_target_encoder(train: DataFrame, target: str = "is_canceled", columns: list[str] | None = None,
                       smoothing: float = ENCODER_SMOOTHING) -> EncoderModel:
    """A28 + A29: per-key count and smoothed target mean, (mean*n + prior*m) / (n + m)."""
    cols = list(columns or TARGET_ENCODED_COLUMNS)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" if c in train.columns else f"'{c}', CAST(NULL AS STRING)"
                      for c in cols)
    long = train.selectExpr(f"CAST(`{target}` AS DOUBLE) AS _y", f"stack({len(cols)}, {pairs}) as (column, key)")
    long = long.withColumn("key", unknown_if_missing("key"))
    # one pass over the train rows; the (column, key) table is read again by the prior and by
    # each lookup, so it is materialised once
    grp = long.groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_sy")).checkpoint(
        eager=True)
    grp = grp.withColumn("_mean", F.col("_sy") / F.col("n"))
    # the prior is the train mean: every row appears once under the first column's keys
    prior = grp.where(F.col("column") == cols[0]).agg(
        F.coalesce(F.sum("_sy") / F.sum("n"), F.lit(ENCODER_DEFAULT_PRIOR)).alias("prior"))
    m = F.lit(float(smoothing))
    stats = grp.crossJoin(F.broadcast(prior)).select(
        "column", "key", "n", ((F.col("_mean") * F.col("n") + F.col("prior") * m) / (F.col("n") + m)).alias("smooth_mean"))
    return EncoderModel(stats=stats, prior=prior, columns=cols, smoothing=smoothing)


#: Columns whose log frequency is a feature too.
FREQUENCY_COLUMNS = ("agent", "company_raw")

#: The wide variant: nine log frequencies, six of them with target means, smoothed with 100 rows.
WIDE_FREQUENCIES = ("country", "agent", "company_raw", "market_segment", "distribution_channel", "reserved_room_type", "deposit_type",
                    "customer_type", "hotel")
WIDE_MEANS = WIDE_FREQUENCIES[:6]
WIDE_SMOOTHING = 100.0


def _prefix(col: str) -> str:
    return "company" if col == "company_raw" else col


def encoder_keys(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """The key of each encoded column; a column that is not there is unknown."""
    return {c: unknown_if_missing(F.col(c)) if c in df.columns else F.lit("Unknown") for c in columns}


def encoded_columns(means: list[str], frequencies: list[str], found: str = "_found") -> dict[str, Column]:
    """Feature columns from what ``lookup_columns`` found and the column ``prior``: unseen -> prior / 0."""
    of = lambda c, f: F.col(f"`{found}`.`{c}`.`{f}`")
    return {**{f"{_prefix(c)}_freq_log": F.log1p(F.coalesce(of(c, "n").cast("double"), F.lit(0.0))) for c in frequencies},
            **{f"{_prefix(c)}_target_mean_smooth": F.coalesce(of(c, "smooth_mean"), F.col("prior")) for c in means}}


def transform_target_encoder(df: DataFrame, model: EncoderModel, means: list[str] | None = None, frequencies: list[str] | None = None) -> DataFrame:
    """Smoothed means of ``means`` (all columns of the model) and log frequencies of ``frequencies``
    (those of FREQUENCY_COLUMNS), one lookup for all; unseen -> prior (target mean) / 0 (frequency)."""
    means = list(model.columns if means is None else means)
    frequencies = [c for c in model.columns if c in FREQUENCY_COLUMNS] if frequencies is None else list(frequencies)
    out = df.crossJoin(F.broadcast(model.prior))  # one row
    out = lookup_columns(out, encoder_keys(df, list(dict.fromkeys([*means, *frequencies]))), model.stats, ["n", "smooth_mean"])
    return out.withColumns(encoded_columns(means, frequencies)).drop("prior", "_found")


def wide_encoding(df: DataFrame, train: DataFrame, target: str = "is_canceled") -> DataFrame:
    """M4: nine log frequencies and six target means of m = 100, counted on ``train`` only."""
    model = fit_target_encoder(train, target, list(WIDE_FREQUENCIES), WIDE_SMOOTHING)
    return transform_target_encoder(df, model, list(WIDE_MEANS), list(WIDE_FREQUENCIES))


def frequency_table(train: DataFrame, columns: list[str]) -> DataFrame:
    """Category frequency and log1p of it, per column."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = train.selectExpr(f"stack({len(columns)}, {pairs}) as (column, key)")
    long = long.withColumn("key", unknown_if_missing("key"))
    return long.groupBy("column", "key").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "freq_log", F.log1p(F.col("n").cast("double")))


def fit_quantile_clip(train: DataFrame, columns: list[str], key: str, low: float = 0.001,
                      high: float = 0.999) -> DataFrame:
    """Train-only clip edges per numeric column (exact quantiles from cells of values). One row."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    wide = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).checkpoint(eager=True)
    q = exact_quantiles(wide.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)"), "value", [low, high], partition_by=["column"], written=True)
    edges = [F.max(F.when((F.col("column") == c) & (F.col("_i") == i), F.col("q"))).alias(f"{c}_{end}") for c in columns for i, end in enumerate(("lo", "hi"))]
    return q.agg(*edges)


def apply_quantile_clip(df: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """least(greatest(x, lo), hi) with the one-row edge table broadcast."""
    j = df.crossJoin(F.broadcast(edges))
    out = j.withColumns({c: F.least(F.greatest(F.col(c), F.col(f"`{c}_lo`")), F.col(f"`{c}_hi`")) for c in columns})
    return out.drop(*[f"{c}_{s}" for c in columns for s in ("lo", "hi")])
