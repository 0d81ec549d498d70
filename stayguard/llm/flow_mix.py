"""Mixing sources to target weights: min-cost flow for overlapping sources.

Documents are summed by membership pattern (the set of sources that may use them). What
reaches the driver is one row per pattern. There, token capacity flows from patterns to
source quotas; the k-th use of the same words costs more than the one before, so words
repeat only where fresh ones have run out. Each pattern's flow is then spent on its
documents in a seeded order: all of them whole times, and one time more up to the point
where the flow is used up. That point is found from sums by hash bucket, and row by row
only inside the one bucket that holds it, so no group of documents meets in one task.

Rows: null text has size 0; a null source is a source of its own; repeated rows are
separate documents (equal rows are interchangeable); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import id_hash
from .bytewise import word_counts
from .scratch import saved

MAX_REPEATS = 3
#: Cost of using the same words for the k-th time; convex.
REPEAT_COSTS = (0, 1, 3)
SEED = 20
BUCKETS = 1024
WEIGHTS = (1, 2, 3)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """id, the kept columns, and size: the words of the whole text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(word_counts(b.columns[-1]), pa.int64())],
                                             names=[*b.schema.names[:-1], "size"])

    narrow = docs.select(id_col, *keep, text_col)
    fields = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return narrow.mapInArrow(count, f"{fields}, size bigint")


def targets(by_source: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Shares of all words by weight; what is over ``most`` times a source's size goes to the others by weight."""
    names = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, active = sum(by_source.values()), {}, list(names)
    while active:
        share = Fraction(total - sum(out.values()), sum(weight[s] for s in active))
        over = [s for s in active if share * weight[s] > most * by_source[s]]
        if not over:
            out |= {s: share * weight[s] for s in active}
            break
        out |= {s: Fraction(most * by_source[s]) for s in over}
        active = [s for s in active if s not in over]
    return {s: float(out[s]) for s in names}


def route(capacity: dict[str, int], members: dict[str, list], quota: dict, costs: tuple[int, ...] = REPEAT_COSTS) -> dict[tuple[str, object], int]:
    """Tokens from each pattern to each source, of least cost, by successive shortest paths.

    Arcs: start to pattern (one per repetition, with that repetition's cost), pattern to
    each of its sources, source to end (the quota).
    """
    patterns, sources = sorted(capacity), list(quota)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    arcs: list[list[int]] = []  # head, room, cost; the reverse arc is at index ^ 1
    out: list[list[int]] = [[] for _ in range(2 + len(node))]

    def arc(u: int, v: int, room: int, cost: int) -> None:
        for a, b, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            out[a].append(len(arcs))
            arcs.append([b, r, c])

    for p in patterns:
        for cost in costs:
            arc(0, node["p", p], capacity[p], cost)
    edges = {}
    for p in patterns:
        for s in members[p]:
            edges[p, s] = len(arcs)
            arc(node["p", p], node["s", s], sum(capacity.values()) * len(costs), 0)
    for s in sources:
        arc(node["s", s], 1, quota[s], 0)
    height = [0] * len(out)
    while True:
        far, via, queue = [None] * len(out), [-1] * len(out), [(0, 0)]
        far[0] = 0
        done = [False] * len(out)
        while queue:
            d, u = heapq.heappop(queue)
            if done[u]:
                continue
            done[u] = True
            for a in out[u]:
                v, room, cost = arcs[a]
                new = d + cost + height[u] - height[v]
                if room > 0 and not done[v] and (far[v] is None or new < far[v]):
                    far[v], via[v] = new, a
                    heapq.heappush(queue, (new, v))
        if far[1] is None:
            break
        height = [h + (f if f is not None else 0) for h, f in zip(height, far)]
        path, v = [], 1
        while v:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[a][1] for a in path)
        for a in path:
            arcs[a][1] -= push
            arcs[a ^ 1][1] += push
    return {k: arcs[a ^ 1][1] for k, a in edges.items() if arcs[a ^ 1][1]}


def mix(items: DataFrame, quota: dict, id_col: str = "doc_id", members_col: str = "members", size_col: str = "size",
        seed: int = SEED, costs: tuple[int, ...] = REPEAT_COSTS) -> DataFrame:
    """``items`` with taken: the words of each document that the mix uses, repeats counted.

    ``members_col`` is an array of the sources that may use the document; ``quota`` has the
    words each source wants. ``items`` is read more than once, so it should be a written table.
    """
    spark = items.sparkSession
    key = F.to_json(F.array_sort(F.array_distinct(members_col)))
    rows = items.withColumn("_pattern", key).withColumn("_hash", id_hash(F.col(id_col), seed)) \
        .withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))
    sums = saved(rows.groupBy("_pattern", "_bucket").agg(F.sum(size_col).alias("_sum")), "bucket-sums")
    capacity = {r["_pattern"]: int(r["n"]) for r in sums.groupBy("_pattern").agg(F.sum("_sum").alias("n")).collect()}
    whole = {s: max(0, math.floor(q + 0.5)) for s, q in quota.items()}
    flow: dict[str, int] = dict.fromkeys(capacity, 0)
    for (p, _), n in route(capacity, {p: [s for s in json.loads(p) if s in whole] for p in capacity}, whole, costs).items():
        flow[p] += n
    plan = [(p, flow[p] // n if n else 0, flow[p] % n if n else 0) for p, n in capacity.items()]
    plan = spark.createDataFrame(plan, "_pattern string, _times bigint, _rest bigint")

    upto = Window.partitionBy("_pattern").orderBy("_bucket")
    marks = sums.join(plan, "_pattern").withColumn("_after", F.sum("_sum").over(upto))
    marks = marks.select("_pattern", "_bucket", "_times", "_rest", (F.col("_after") - F.col("_sum")).alias("_before"),
                         F.when(F.col("_after") <= F.col("_rest"), 1).when(F.col("_after") - F.col("_sum") >= F.col("_rest"), 0).alias("_more"))
    placed = rows.join(marks, ["_pattern", "_bucket"])
    settled = placed.filter("_more is not null")
    inside = Window.partitionBy("_pattern", "_bucket").orderBy("_hash", id_col, size_col)
    edge = placed.filter("_more is null") \
        .withColumn("_at", F.col("_before") + F.sum(size_col).over(inside.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("_more", (F.col("_at") <= F.col("_rest")).cast("int")).drop("_at")
    out = saved(settled.unionByName(edge).drop("_before"), "placed")

    # what is still missing is less than one document: use once more the one whose size comes nearest
    used = saved(out.groupBy("_pattern").agg((F.first("_rest") - F.sum(F.col(size_col) * F.col("_more"))).alias("_miss")), "missing")
    spare = out.filter("_more = 0").groupBy("_pattern", "_hash", F.col(id_col).alias("_id"), F.col(size_col).alias("_size")) \
        .agg((F.count("*") * F.first(size_col)).alias("_whole")).join(used, "_pattern")  # equal rows go together
    gap = F.abs(F.col("_whole") - F.col("_miss"))
    last = spare.filter(gap < F.col("_miss")).groupBy("_pattern").agg(F.min_by(F.struct("_hash", "_id", "_size"), F.struct(gap, F.col("_hash"), F.col("_size"))).alias("l"))
    last = last.select(F.col("_pattern").alias("_p"), F.col("l._hash").alias("_h"), F.col("l._id").alias("_i"), F.col("l._size").alias("_s"))
    hit = (F.col("_pattern") == F.col("_p")) & (F.col("_hash") == F.col("_h")) & F.col(id_col).eqNullSafe(F.col("_i")) & (F.col(size_col) == F.col("_s"))
    times = F.col("_times") + F.col("_more") + (F.col("_s").isNotNull() & (F.col("_more") == 0)).cast("int")
    return out.join(last, hit, "left").select(*items.columns, (F.col(size_col) * times).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken."""
    table = saved(sizes(docs, id_col, text_col, (source_col,)), "sizes")
    by_source = {r[source_col]: int(r["n"]) for r in table.groupBy(source_col).agg(F.sum("size").alias("n")).collect()}
    goal = targets(by_source)
    rows = mix(table.withColumn("members", F.array(source_col)), goal, id_col, seed=seed).drop("members")
    facts = docs.sparkSession.createDataFrame([(s, by_source[s], goal[s]) for s in goal],
                                              f"_source {docs.schema[source_col].dataType.simpleString()}, source_size bigint, target double")
    return rows.join(facts, F.col(source_col).eqNullSafe(F.col("_source")), "left") \
        .select(id_col, "size", "source_size", F.round("target", 6).alias("target"), "taken", source_col)


#: The result of ``mixed`` in SQL (a document belongs to one source). The level of the weighted shares is
#: found among the sources in the order of three sizes per weight: those before it are full.
SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, row_number() OVER () AS row FROM documents
), sources AS (
  SELECT source, SUM(size) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM docs GROUP BY source
), ordered AS (
  SELECT *, {MAX_REPEATS} * n / w AS full_at, SUM(n) OVER () AS total,
    coalesce(SUM({MAX_REPEATS} * n) OVER (ORDER BY {MAX_REPEATS} * n / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    SUM(w) OVER (ORDER BY {MAX_REPEATS} * n / w, w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM sources
), level AS (
  SELECT coalesce(MAX((total - filled) / weights) FILTER (WHERE (total - filled) / weights <= full_at), 1e300) AS level FROM ordered
), goals AS (
  SELECT source, n, LEAST({MAX_REPEATS} * n, level * w) AS target, CAST(FLOOR(LEAST({MAX_REPEATS} * n, level * w) + 0.5) AS BIGINT) AS quota FROM ordered, level
), hashed AS (
  SELECT d.*, n, target, LEAST(quota, {MAX_REPEATS} * n) AS flow, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), placed AS (
  SELECT *, CASE WHEN n > 0 THEN flow // n ELSE 0 END AS times, CASE WHEN n > 0 THEN flow % n ELSE 0 END AS rest,
    SUM(size) OVER (PARTITION BY source ORDER BY h % {BUCKETS}, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM hashed
), chosen AS (SELECT *, CASE WHEN upto <= rest THEN 1 ELSE 0 END AS more FROM placed),
missing AS (SELECT *, rest - SUM(size * more) OVER (PARTITION BY source) AS miss FROM chosen),
spare AS (
  SELECT *, CASE WHEN more = 0 AND miss > 0 AND ABS(size - miss) < miss THEN row_number() OVER (PARTITION BY source, more = 0 AND miss > 0 AND ABS(size - miss) < miss
    ORDER BY ABS(size - miss), h, size) END AS nth FROM missing
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, ROUND(CAST(target AS DOUBLE), 6) AS target,
  CAST(size * (times + more + CASE WHEN nth = 1 THEN 1 ELSE 0 END) AS BIGINT) AS taken, source
FROM spare
"""
