"""Order statistics and sums of the top rows without ordering the table.

One pass of approximate quantiles cuts the values of each group into cells, a second pass counts
(and sums) each cell exactly, and only the rows of the cells that hold a wanted rank move: they are
ordered inside their cell. The cells cover the whole line, so the counts are exact whatever
the sketch said; a bad sketch costs rows, never the result. A cell of more than ``LIMIT`` rows is cut
anew from its own rows, one value at last by its ids (bounds from ids of the least hashes), until no window is larger.

All functions read their rows two or more times: pass a narrow table that is written
(``checkpoint``), or the passes repeat the plan above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell that one window may order.
LIMIT = 1_000_000
#: The sketch: rank error one in ACCURACY, so a cell from MARGIN below a wanted rank to MARGIN above holds it.
ACCURACY = 10_000
MARGIN = 0.0005
#: Cells that a cell of too many rows is cut into.
FANOUT = 64


#: Rows of a table of bounds or cells that the driver holds; a larger one is written.
HELD = 10_000


def fixed(df: DataFrame) -> DataFrame:
    """The same rows on each later read, without the plan above them: bounds, counts and cuts are a few rows a group.

    What the driver holds is broadcast: its size is unknown to the planner, and a shuffled join would send all rows of a group to one task."""
    rows = df.limit(HELD + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= HELD else df.checkpoint(eager=True)


def same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, NULL equal to NULL, keeping the left ones; without columns, with a one-row table."""
    if not on:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_on_{c}"))
        cond = one if cond is None else cond & one
    return left.join(right, cond, how).drop(*[f"_on_{c}" for c in on])


def cut(rows: DataFrame, groups: Sequence[str], value: str, points: Sequence[float], cell: str) -> DataFrame:
    """Rows with the number of the group's bounds (about the quantiles at ``points``) below their value as ``cell``; NULL values come last."""
    at = sorted({min(max(p, 0.0), 1.0) for p in points})
    bounds = rows.groupBy(*groups).agg(F.percentile_approx(value, at, ACCURACY).alias("_b"))
    return in_cells(rows, groups, value, bounds, cell)


def cut_ids(rows: DataFrame, groups: Sequence[str], key: str, largest: int, cell: str) -> DataFrame:
    """As ``cut``, by the order of ids of any type: the bounds are the ids whose hash falls in about FANOUT of the largest group's rows."""
    some = F.pmod(F.xxhash64(key), F.lit(max(1, largest // FANOUT))) == 0
    bounds = rows.where(some).groupBy(*groups).agg(F.collect_set(key).alias("_b"))
    return in_cells(rows, groups, key, bounds, cell)


def in_cells(rows: DataFrame, groups: Sequence[str], value: str, bounds: DataFrame, cell: str) -> DataFrame:
    # merging sketches in another order could give other bounds: fix them
    kind = dict(bounds.dtypes)["_b"]
    if not groups:
        b = bounds.first()["_b"]
        out = rows.withColumn("_b", (F.array(*[F.lit(x) for x in b]) if b else F.array()).cast(kind))
    else:
        out = same(rows, fixed(bounds), groups, "left")
    below = F.size(F.filter(F.coalesce("_b", F.array().cast(kind)), lambda b: b < F.col(value)))
    return out.withColumn(cell, F.when(F.col(value).isNull(), F.lit(2 ** 31 - 1)).otherwise(below)).drop("_b")


def before(counts: DataFrame, groups: Sequence[str], cell: str, sums: Sequence[str]) -> DataFrame:
    """Counts of cells with what lies in the cells before them (a group has a few hundred cells at most)."""
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({f"_before{s}": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums})


def ranks(vals: DataFrame, groups: Sequence[str], value: str, weight: str, wanted: Sequence[tuple[str, float]]) -> DataFrame:
    """The values at wanted places: one row per (group, place number) with ``_x``, and ``_size``, the weight of the group.

    ``wanted``: ("floor" or "ceil", share): the place floor or ceil(share * (size - 1)), from 0, counting each row ``weight`` times."""
    groups = list(groups)
    points = [s + d for _, s in wanted for d in (-MARGIN, MARGIN)]
    cell, rows, level = "_c0", cut(vals, groups, value, points, "_c0"), 0
    done, targets, keys = None, None, groups
    while True:
        counts = rows.groupBy(*keys, cell).agg(F.sum(weight).cast("long").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        counts = fixed(counts)
        ordered = before(counts, keys, cell, ["_n"])
        if targets is None:
            sizes = counts.groupBy(*groups).agg(F.sum("_n").cast("long").alias("_size"))
            places = [(F.floor if how == "floor" else F.ceil)(F.lit(float(s)) * (F.col("_size") - 1)).cast("long") for how, s in wanted]
            targets = sizes.where("_size > 0").select(*groups, "_size", F.posexplode(F.array(*places)).alias("_t", "_at"))
        hit = same(targets, ordered, keys).where((F.col("_at") >= F.col("_before_n")) & (F.col("_at") < F.col("_before_n") + F.col("_n")))
        hit = hit.withColumn("_at", F.col("_at") - F.col("_before_n")).select(*keys, cell, "_size", "_t", "_at", "_n", "_lo", "_hi")
        hit = fixed(hit)
        one = hit.where("_lo = _hi").select(*groups, "_t", "_size", F.col("_lo").alias("_x"))
        done = one if done is None else done.unionByName(one)
        keys = [*keys, cell]
        targets = hit.where("_lo < _hi").select(*keys, "_size", "_t", "_at")
        largest = hit.where("_lo < _hi").agg(F.max("_n")).first()[0]
        if not largest:
            return done
        rows = same(rows, fixed(targets.select(*keys).distinct()), keys, "left_semi")
        if largest > LIMIT:  # equal values, mostly: one row each, added up before they move
            rows = rows.groupBy(*keys, value).agg(F.sum(weight).cast("long").alias(weight)).checkpoint(eager=True)
            largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if largest <= LIMIT:
            break
        level += 1
        cell = f"_c{level}"
        rows = cut(rows, keys, value, [i / FANOUT for i in range(FANOUT + 1)], cell)
    distinct = rows.groupBy(*keys, value).agg(F.sum(weight).cast("long").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    distinct = distinct.withColumn("_upto", F.sum("_n").over(upto))
    found = same(distinct, targets, keys).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    return done.unionByName(found.select(*groups, "_t", "_size", F.col(value).alias("_x")))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], key: str | None = None, partition_by: list[str] | None = None,
                    weight: Column | None = None, written: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles (numpy / pandas default, DuckDB ``quantile_cont``).

    NULL values are ignored; a row counts ``weight`` times. ``written``: df is cheap to read again.
    Returns one row per (group, prob): ``_i``, ``prob``, ``q``.
    """
    groups = list(partition_by or [])
    vals = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"),
                                                     (F.lit(1) if weight is None else weight).cast("long").alias("_w")).where("_w > 0")
    if not written:
        vals = vals.checkpoint(eager=True)
    places = ranks(vals, groups, "_v", "_w", [(how, float(q)) for q in probs for how in ("floor", "ceil")])
    i = F.floor(F.col("_t") / 2).cast("int")
    pair = places.groupBy(*groups, i.alias("_i")).agg(F.max("_size").alias("_size"), F.max(F.when(F.col("_t") % 2 == 0, F.col("_x"))).alias("_lo"),
                                                      F.max(F.when(F.col("_t") % 2 == 1, F.col("_x"))).alias("_hi"))
    prob = F.element_at(F.array(*[F.lit(float(q)) for q in probs]), F.col("_i") + 1)
    pos = prob * (F.col("_size") - 1)
    return pair.select(*groups, "_i", prob.alias("prob"), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))).alias("q"))


def _falling(score: str) -> Column:
    """Rises as the score falls (NaN, the largest double, first)."""
    x = F.col(score).cast("double")
    return F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(-x)


def top_sums(rows: DataFrame, groups: Sequence[str], score: str, key: str, measures: dict[str, Column], shares: Sequence[tuple[float, Column]]) -> DataFrame:
    """Sums of measures over the top rows of each group (score falling, NULL last, then id): one row per (group, share number ``_t``)
    with ``_k`` rows summed, ``_size`` rows in the group, and the measures.

    ``shares``: (about this share of the rows, the exact number of rows as a function of ``_size``)."""
    groups, names = list(groups), list(measures)
    sums = ["_n", *names]
    rows = rows.select(*groups, F.col(key).alias("_id"), _falling(score).alias("_o"), *[m.alias(n) for n, m in measures.items()])
    cell, level = "_c0", 0
    rows = cut(rows, groups, "_o", [s + d for s, _ in shares for d in (-MARGIN, MARGIN)], cell)
    done, targets, keys = None, None, groups
    while True:
        counts = rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in names], F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
        counts = fixed(counts)
        ordered = before(counts, keys, cell, sums)
        if targets is None:
            sizes = counts.groupBy(*groups).agg(F.sum("_n").cast("long").alias("_size"))
            targets = sizes.select(*groups, "_size", F.posexplode(F.array(*[k.cast("long") for _, k in shares])).alias("_t", "_k"))
            targets = targets.withColumns({"_room": F.least("_k", "_size"), **{f"_sum{n}": F.lit(0) for n in names}})
        hit = same(targets, ordered, keys).where((F.col("_room") > F.col("_before_n")) & (F.col("_room") <= F.col("_before_n") + F.col("_n")))
        hit = hit.withColumns({"_room": F.col("_room") - F.col("_before_n"), **{f"_sum{n}": F.col(f"_sum{n}") + F.col(f"_before{n}") for n in names}})
        hit = hit.select(*keys, cell, "_size", "_t", "_k", "_room", "_n", "_lo", "_hi", *names, *[f"_sum{n}" for n in names])
        hit = fixed(hit)
        whole = hit.where("_room = _n").select(*groups, "_t", "_size", "_k", *[(F.col(f"_sum{n}") + F.coalesce(n, F.lit(0))).alias(n) for n in names])
        done = whole if done is None else done.unionByName(whole)
        keys = [*keys, cell]
        cuts = hit.where("_room < _n")
        targets = cuts.select(*keys, "_size", "_t", "_k", "_room", *[f"_sum{n}" for n in names])
        largest, by_value = cuts.agg(F.max("_n"), F.max(F.when((F.col("_n") > LIMIT) & (F.col("_lo") < F.col("_hi")), True))).first()
        if not largest:
            return done
        rows = same(rows, fixed(targets.select(*keys).distinct()), keys, "left_semi")
        if largest <= LIMIT:
            break
        level += 1
        cell = f"_c{level}"
        rows = cut(rows, keys, "_o", [i / FANOUT for i in range(FANOUT + 1)], cell) if by_value else cut_ids(rows, keys, "_id", int(largest), cell)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_o"), "_id"))
    inside = same(rows.withColumn("_nth", nth), targets, keys).where("_nth <= _room")
    inside = inside.groupBy(*groups, "_t", "_size", "_k").agg(*[(F.max(f"_sum{n}") + F.coalesce(F.sum(n), F.lit(0))).alias(n) for n in names])
    return done.unionByName(inside)


def best_prefix(rows: DataFrame, score: str, key: str, gain: Column, measures: dict[str, Column]) -> DataFrame:
    """The prefix (score falling, NULL last, then id) with the largest sum of ``gain``, the shortest of equal ones:
    one row with ``k``, ``net`` and the sums of the measures; no row where there are none, or where no prefix gains anything.

    A cell can hold the end of the best prefix only if the sum before it plus its positive gains reaches the best sum at any cell's end;
    rows are ordered in such cells only."""
    names = list(measures)
    rows = rows.select(F.col(key).alias("_id"), _falling(score).alias("_o"), gain.alias("_gain"), *[m.alias(n) for n, m in measures.items()])
    at = [i / FANOUT for i in range(FANOUT + 1)]
    cell, level, keys = "_c0", 0, []
    rows = cut(rows, [], "_o", at, cell)
    open_ = None  # cells that are left, with the sums before them
    best = 0.0
    carried = ["_n", "_gain", *names]
    while True:
        counts = rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"), F.sum("_gain").alias("_gain"), F.sum(F.greatest("_gain", F.lit(0.0))).alias("_up"),
                                               *[F.sum(n).alias(n) for n in names], F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
        cells = before(counts, keys, cell, carried)
        if open_ is not None:
            cells = same(cells, open_.select(*keys, *[F.col(f"_start{c}").alias(f"_up{c}") for c in carried]), keys)
            cells = cells.withColumns({f"_before{c}": F.col(f"_before{c}") + F.col(f"_up{c}") for c in carried})
        keys = [*keys, cell]
        cells = fixed(cells.select(*keys, "_n", "_gain", "_up", "_lo", "_hi", *[F.col(f"_before{c}").alias(f"_start{c}") for c in carried]))
        best = max(best, cells.agg(F.max(F.col("_start_gain") + F.col("_gain"))).first()[0] or 0.0)
        slack = 1e-9 * (1.0 + abs(best))  # sums by cell and row by row differ in the last digits
        open_ = cells.where((F.col("_up") > 0) & (F.col("_start_gain") + F.col("_up") >= best - slack))
        largest, by_value = open_.agg(F.max("_n"), F.max(F.when((F.col("_n") > LIMIT) & (F.col("_lo") < F.col("_hi")), True))).first()
        rows = same(rows, fixed(open_.select(*keys)), keys, "left_semi")
        if not largest or largest <= LIMIT:
            break
        level += 1
        cell = f"_c{level}"
        rows = cut(rows, keys, "_o", at, cell) if by_value else cut_ids(rows, keys, "_id", int(largest), cell)
    upto = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_o"), "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({"_n": F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_o"), "_id")),
                            **{f"_r{c}": F.sum(c).over(upto) for c in carried[1:]}})
    run = same(run, open_.select(*keys, *[f"_start{c}" for c in carried]), keys)
    ends = run.select((F.col("_start_n") + F.col("_n")).alias("k"), (F.col("_start_gain") + F.col("_r_gain")).alias("net"),
                      *[(F.col(f"_start{n}") + F.col(f"_r{n}")).alias(n) for n in names])
    top = ends.agg(F.min_by(F.struct("k", "net", *names), F.struct((-F.col("net")).alias("a"), F.col("k").alias("b"))).alias("b"))
    return top.where("b is not null").select("b.*")
