"""Ranked retrieval by sequential reads of impact-sorted lists (NRA, operator 11).

Three passes over the documents. The first counts, for each document, the terms that the
queries hold and writes them with the document's length; the second sums document
frequencies and lengths; the third scores. There a task takes its documents in shards of
bounded size, lays out for each term the list of its documents by falling impact, and reads
the lists of a query from their heads, a block at a time, without random access. Each
document met has a lower bound (what was read) and an upper bound (plus the heads of the
lists that it was not met in). Documents whose upper bound falls below the k-th best lower bound leave;
documents not yet met are out once the sum of the heads does. Reading goes on until all that are left
have equal bounds: membership, ties and final scores are then settled. The k best of
the shards before give the next shard its first bound. What the tasks found, at most k rows a
query and task, is merged in two steps by window.

Queries come in blocks of about ``BLOCK_TERMS`` (query, term) pairs by a hash of their id, so what the driver
and the tasks hold of them is bounded; each block is a pass of its own over the documents.

Defined results: a NULL or empty text has no terms, so it is never ranked and does not count as a document;
rows of one query id are one query of all their terms; each document row is ranked by itself, so
repeated rows share a score and hold a rank each; NULL ids rank after others of their score. A query
without a matching document has no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved

TOP = 50
#: (query, term) pairs of a block of queries.
BLOCK_TERMS = 1_000_000
#: Documents of a shard, and cells of the table of a query's terms by them.
SHARD = 32_768
SEEN_CELLS = 64_000_000
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20
#: Entries read of a list in the first block; each later block doubles.
FIRST_READ = 128
#: Tasks whose findings meet in one group of the first merge.
TASKS = 64

#: Fixed values of the score: 100 * b and its complement, scale of a term's part.
WHOLE, PART, SCALE = 100, 50, 1_000_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item long, task int, doc_id long, score long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in slices of bounded size."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Each document's length in terms and its counts of the vocabulary's terms, by number."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, terms, tfs = [], [], []
            for text in b.column(1):
                n, seen = 0, Counter()
                if text.is_valid:
                    for part in terms_of(text.as_buffer().to_pybytes()):
                        n += len(part)
                        seen.update(part)
                known = [(number[t], c) for t, c in seen.items() if t in number]
                lengths.append(n)
                terms.append([t for t, _ in known])
                tfs.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                                             ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(count, COUNTED)


class Lists:
    """The impact-sorted lists of a shard. An entry's impact without the term's weight is (SCALE * tf) div (1000 * tf + 20 * m)."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, total: int, n_terms: int):
        m = WHOLE - PART + (PART * n * n_docs) // total
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = (SCALE * tfs) // (1000 * tfs + 20 * m[doc])
        order = np.argsort((terms << 20) + ((1 << 20) - 1 - impact), kind="stable")  # impacts are below 10 ** 6
        self.doc, self.impact, self.n = doc[order], impact[order], len(n)
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def best(self, query: np.ndarray, weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of the shard that can be among the k best of a query, with their exact scores, and the entries read.

        ``least``: the score of the k-th best of other shards, 0 if there are fewer."""
        query = query[(weights[query] > 0) & (self.starts[query + 1] > self.starts[query])]
        weight, at, end = weights[query], self.starts[query].copy(), self.starts[query + 1]
        lower = np.zeros(self.n, np.int64)
        unseen = np.ones((len(query), self.n), bool)
        head = weight * self.impact[at] if len(query) else np.zeros(0, np.int64)
        left: np.ndarray | None = None  # documents still open, once no others can come in
        size, read = FIRST_READ, 0
        while True:
            for t in np.flatnonzero(at < end):
                upto = min(at[t] + size, end[t])
                docs = self.doc[at[t]:upto]
                lower[docs] += weight[t] * self.impact[at[t]:upto]
                unseen[t, docs] = False
                read += len(docs)
                at[t] = upto
                head[t] = weight[t] * self.impact[upto] if upto < end[t] else 0
            met = np.flatnonzero(lower) if left is None else left
            bound = least
            if len(met) >= k:
                bound = max(bound, int(np.partition(lower[met], len(met) - k)[len(met) - k]))
            upper = lower[met] + head @ unseen[:, met]
            if left is not None or head.sum() < bound or not head.any():
                met, upper = met[upper >= bound], upper[upper >= bound]
                left = met
                if (upper == lower[met]).all():
                    return met, lower[met], read
            size *= 2


def best_of(ids: np.ndarray, none: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score falling, id rising, no id last."""
    return np.lexsort((ids, none, -scores))[:k]


def searched_shards(rows: DataFrame, queries: dict[int, np.ndarray], weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """The k best of each query among the documents of each task."""
    longest = max((len(q) for q in queries.values()), default=1)
    shard = max(1, min(SHARD, SEEN_CELLS // longest))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = {q: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for q in queries}

        def take(some: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(some).combine_chunks()
            ids, n, terms, tfs = (c.chunk(0) for c in table.columns)
            none = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            sizes = np.diff(terms.offsets.to_numpy())
            lists = Lists(n.to_numpy(), sizes, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), n_docs, total, len(weights))
            for q, query in queries.items():
                i, o, s = best[q]
                docs, scores, _ = lists.best(query, weights, int(s[-1]) if len(s) == k else 0, k)
                docs, scores = docs[scores > 0], scores[scores > 0]
                i, o, s = np.concatenate([i, ids[docs]]), np.concatenate([o, none[docs]]), np.concatenate([s, scores])
                first = best_of(i, o, s, k)
                best[q] = i[first], o[first], s[first]

        held: list[pa.RecordBatch] = []
        for b in batches:
            for a in range(0, b.num_rows, shard):
                part = b.slice(a, shard)
                if held and sum(x.num_rows for x in held) + part.num_rows > shard:
                    take(held)
                    held = []
                held.append(part)
        if held:
            take(held)
        task = TaskContext.get().partitionId()
        for q, (i, o, s) in best.items():
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q)), pa.array(np.full(len(s), task), pa.int32()), pa.array(i, pa.int64(), mask=o), pa.array(s)],
                                                 ["item", "task", "doc_id", "score"])

    return rows.mapInArrow(search, FOUND)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (query id, term) pairs."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    return queries.select(F.col(id_col).cast("long").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), 0)).alias("term")).distinct()


def ranked(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of each query: (id_col, rank, doc_id, score)."""
    spark = docs.sparkSession
    pairs = saved(query_terms(queries, id_col, text_col), "terms")
    blocks = -(-pairs.count() // block_terms)
    out = spark.createDataFrame([], f"{id_col} long, rank int, doc_id long, score long")
    for block in range(blocks):
        held = pairs.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # about block_terms pairs
        if held:
            out = out.unionByName(ranked_block(docs, [(r["id"], r["term"].encode()) for r in held], k, id_col))
    return out


def ranked_block(docs: DataFrame, held: list[tuple[int | None, bytes]], k: int, id_col: str) -> DataFrame:
    vocabulary = sorted({t for _, t in held})
    number = {t: i for i, t in enumerate(vocabulary)}
    names = sorted({q for q, _ in held}, key=lambda q: (q is None, q or 0))
    terms: dict[int | None, list[int]] = {}
    for q, t in held:
        terms.setdefault(q, []).append(number[t])
    rows = saved(counted(docs, vocabulary), "counted")
    stats = rows.where("n > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("total")).first()
    if not stats["n_docs"]:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, rank int, doc_id long, score long")
    held_by = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # one row to a term of the block
    weights = np.zeros(len(vocabulary), np.int64)
    for r in held_by:
        weights[r["t"]] = weight(stats["n_docs"], r["df"])
    lists = {i: np.array(sorted(terms[q]), np.int64) for i, q in enumerate(names)}
    found = searched_shards(rows.where(F.size("terms") > 0), lists, weights, int(stats["n_docs"]), int(stats["total"]), k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = Window.partitionBy("item", F.floor(F.col("task") / TASKS)).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    ids = docs.sparkSession.createDataFrame(list(enumerate(names)), "item long, name long")  # of the block
    return found.join(F.broadcast(ids), "item").select(F.col("name").alias(id_col), "rank", "doc_id", "score")


SQL = rf"""
WITH query_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), rows AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents
), lengths AS (SELECT row_no, doc_id, len(terms) AS n FROM rows WHERE len(terms) > 0
), totals AS (SELECT COUNT(*) AS n_docs, CAST(SUM(n) AS BIGINT) AS total FROM lengths
), counts AS (
  SELECT row_no, term, COUNT(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM rows)
  WHERE term IN (SELECT term FROM query_terms) GROUP BY row_no, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, COUNT(*) AS df FROM counts GROUP BY term), totals
), parts AS (
  SELECT c.row_no, c.term, w.w * (({SCALE} * c.tf) // (1000 * c.tf + 20 * ({WHOLE} - {PART} + ({PART} * l.n * t.n_docs) // t.total))) AS part
  FROM counts c JOIN weights w USING (term) JOIN lengths l USING (row_no), totals t
), scores AS (
  SELECT item_id, row_no, SUM(part) AS score FROM query_terms JOIN parts USING (term) GROUP BY item_id, row_no HAVING SUM(part) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN lengths USING (row_no)) WHERE rank <= {TOP}
"""
