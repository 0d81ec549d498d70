"""Approximate nearest neighbours: an inverted multi-index.

Each vector is cut into two halves and each half is quantised by its own centroids; a pair of
centroids is a cell. A query visits cells by the sum of its two squared distances to the
cell's centroids, least first, taken from a heap that grows over the two sorted lists of
centroids, until the cells visited hold the wanted share of all entries. The entries of those
cells are then ranked by their exact Euclidean distance, in double precision, on the original
vectors. Cells with the same first centroid are ranked together, so a query's vector travels
once to each of those regions, with the list of its cells there.

Centroids are fitted (Lloyd's steps) on at most ``SAMPLE`` vectors, the least by a hash of the
id; every vector is indexed. The number of centroids grows with the fourth root of the
table, up to ``MOST_CENTROIDS``; regions of more than ``PART`` entries are cut into parts that
are ranked apart, so a crowded cell is never one task's work. Equal vectors are one entry
that keeps its least ``k + 1`` ids, which is all that a query can need of them.

Rows: a null or zero vector, one with a null or non-finite component, one of another length
than most, or one without an id takes no part; rows that share id and vector are one; ties
go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved

K_NEAREST = 10
SAMPLE = 20_000
MOST_CENTROIDS = 256
CELL_ENTRIES = 24  # entries of a cell that the number of centroids aims at
#: Share of all entries that a query visits, and their least number. A large share is what vectors with
#: independent components need; clustered ones are found with far less.
SHARE, LEAST = 0.5, 3000
PART = 2048
CHUNK = 256  # queries ranked at a time
STEPS = 12


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    x = F.col("vector")
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
                       & F.exists(x, lambda v: v != 0))
    sizes = rows.groupBy(F.size(x).alias("n")).agg(F.count("*").alias("rows"))
    common = sizes.agg(F.max_by("n", F.struct("rows", "n")).alias("n"))
    return rows.join(F.broadcast(common), F.size(x) == F.col("n")).drop("n").distinct()  # common is one row


def entries(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: vector, and its least k + 1 ids in order."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("_nth") <= k + 1)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def lloyd(x: np.ndarray, n: int, steps: int = STEPS, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of x; fewer if it has fewer distinct rows."""
    x = x[np.random.default_rng(seed).permutation(len(x))]
    centroids = np.unique(x[:4 * n], axis=0)
    centroids = centroids[np.random.default_rng(seed).permutation(len(centroids))[:n]]
    for _ in range(steps):
        nearest = np.argmin((centroids ** 2).sum(1) - 2 * x @ centroids.T, axis=1)
        count = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x ** 2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids ** 2).sum(1)


def visited(a: np.ndarray, b: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
    """Cells in order of a[i] + b[j] until they hold ``least`` entries; empty ones are left out."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, found, held = [(a[ia[0]] + b[ib[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        cell = int(ia[i]) * len(b) + int(ib[j])
        if counts[cell]:
            found.append(cell)
            held += int(counts[cell])
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (a[ia[i2]] + b[ib[j2]], i2, j2))
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64) if len(column) else np.zeros((0, 1))


def searched(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K_NEAREST,
             share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query its k nearest found among the other rows.

    ``is_query`` is a condition on the column ``id``. Queries with equal vectors are searched once.
    """
    spark = vectors.sparkSession
    rows = saved(valid(vectors, id_col, vector_col), "vectors")
    table = saved(entries(rows, k), "entries")
    n = table.count()
    queries = rows.filter(is_query)
    asked = saved(queries.groupBy("vector").agg(F.min("id").alias("asked")), "queries")
    sample = table.select("vector", F.col("ids")[0].alias("id")).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(SAMPLE).collect()  # bounded
    if not sample:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    one, two = halves(np.array([r["vector"] for r in sample], np.float64))
    m = int(min(MOST_CENTROIDS, max(1, round((n / CELL_ENTRIES) ** 0.5))))
    first, second = lloyd(one, m), (lloyd(two, m) if two.shape[1] else np.zeros((1, 0)))
    cells = len(first) * len(second)
    books = spark.sparkContext.broadcast((first, second))  # two times MOST_CENTROIDS rows

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for b in parts:
            x, y = halves(_matrix(b.column("vector")))
            cell = _distances(x, first).argmin(1) * len(second) + (_distances(y, second).argmin(1) if y.shape[1] else 0)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.columns], names=["cell", *b.schema.names])

    placed = saved(table.select("vector", "ids").mapInArrow(place, "cell int, vector array<double>, ids array<bigint>"), "cells")
    counts = np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared rows
        counts[r["cell"]] = r["count"]
    held = spark.sparkContext.broadcast(counts)

    wanted, region = max(least, int(np.ceil(share * n))), counts.reshape(len(first), -1).sum(axis=1)

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for b in parts:
            if not b.num_rows:
                continue
            x, y = halves(_matrix(b.column("vector")))
            da, db = _distances(x, first), _distances(y, second) if y.shape[1] else np.zeros((b.num_rows, 1))
            rows, where, part, lists = [], [], [], []
            for q in range(b.num_rows):
                cells = np.array(visited(da[q], db[q], held.value, wanted), np.int64)
                for r in np.unique(cells // len(second)):
                    own = (cells[cells // len(second) == r] % len(second)).tolist()
                    for p in range(-(-int(region[r]) // PART)):
                        rows.append(q)
                        where.append(r)
                        part.append(p)
                        lists.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(part, pa.int32()), *b.take(pa.array(rows, pa.int64())).columns,
                                              pa.array(lists, pa.list_(pa.int32()))], names=["region", "part", *b.schema.names, "seconds"])

    probes = asked.select("asked", "vector").mapInArrow(probe, "region int, part int, asked bigint, vector array<double>, seconds array<int>")
    width = len(second)
    nearest = parted(placed, width).groupBy("region", "part").cogroup(probes.groupBy("region", "part")).applyInPandas(
        lambda left, right: _nearest(left, right, k + 1, width), "asked bigint, id bigint, score double")
    best = F.row_number().over(Window.partitionBy("asked").orderBy("score", "id"))
    nearest = nearest.withColumn("_nth", best).filter(F.col("_nth") <= k + 1).drop("_nth")
    each = queries.select(F.col("id").alias("query_id"), "vector").join(asked, "vector").select("query_id", "asked")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return each.join(nearest, "asked").filter("id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")


def parted(placed: DataFrame, width: int) -> DataFrame:
    """Entries with their region, their second centroid, and the part of the region that they are ranked in."""
    rows = placed.select((F.col("cell") / width).cast("int").alias("region"), (F.col("cell") % width).alias("second"), "vector", "ids")
    sizes = rows.groupBy("region").agg(F.ceil(F.count("*") / PART).alias("_parts"))
    return rows.join(sizes, "region").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("_parts")).cast("int")).drop("_parts")


def _nearest(entries: pd.DataFrame, queries: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """The k nearest ids that a part of a region has for each vector asked, among the cells it visits."""
    out = []
    if len(entries) and len(queries):
        x = np.stack(entries["vector"].to_numpy()).astype(np.float64)
        second, ids, norms = entries["second"].to_numpy(), entries["ids"].to_list(), (x * x).sum(axis=1)
        for at in range(0, len(queries), CHUNK):
            some = queries.iloc[at:at + CHUNK]
            q = np.stack(some["vector"].to_numpy()).astype(np.float64)
            visits = np.zeros((len(q), width), bool)
            for i, cells in enumerate(some["seconds"]):
                visits[i, cells] = True
            rough = np.where(visits[:, second], norms - 2 * q @ x.T + (q * q).sum(axis=1)[:, None], np.inf)
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
            slack = 1e-9 * (norms.max() + (q * q).sum(axis=1))  # above the rounding of the rough distances
            for i, asked in enumerate(some["asked"]):
                near = np.flatnonzero((rough[i] <= edge[i] + slack[i]) & (rough[i] < np.inf))
                if not len(near):
                    continue
                gap = x[near] - q[i]
                score = np.repeat(np.sqrt((gap * gap).sum(axis=1)), [len(ids[e]) for e in near])
                found = np.concatenate([np.asarray(ids[e], np.int64) for e in near])
                best = np.lexsort((found, score))[:k]
                out.append(pd.DataFrame({"asked": asked, "id": found[best], "score": score[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"asked": [], "id": [], "score": []})
