"""MinHash near-dedup: improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Exact copies: texts with equal bytes are one text, the one with the least id.
2. Document frequencies of all five-word shingles over distinct texts, by blocks of texts and
   key ranges (see ``blocks``). A shingle's weight is tf * idf with
   idf = 1 + ln((1 + N) / (1 + df)) / (2 ln(1 + N)), from 1 (in all texts) to 1.5, so that what
   thousands of near copies share still outweighs where they differ; df is kept in steps of
   2**(1/8).
3. ICWS: K samples of each text, each drawn in proportion to weight and equal for two texts
   with the probability of their weighted Jaccard similarity. The draws of a shingle come
   from tables that are indexed by its hash.
4. Banding: texts that share the R samples of a band meet in a bucket. Each is compared with
   the bucket's representative, the least by a hash that differs by band. Then members outside
   a bucket's largest class are compared with all members of other classes (see ``linked``), so
   two texts of a bucket stay uncompared only if they are in one class already. No bucket is
   collected; the pairs grow with its square only where its texts are unlike each other.
5. Verification: weighted Jaccard of the whole shingle vectors, at least ``SIMILARITY``.
6. Classes: connected components of the links, by large-star and small-star steps.

At a similarity of 0.8, one in 4,500 pairs meets in no band (0.85: one in 120,000).

Rows: null text is empty; texts of under five words are one shingle; texts without a word
are near nothing but their copies; a null id has no class (null); rows that share an id are
one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .bytewise import hashes, mix, words
from .scratch import saved

SHINGLE = 5
SIMILARITY = 0.8
K, R = 64, 4
KEY_BITS, KEY_BYTES = 48, 5
#: Entries of the tables of draws.
DRAWS = 1 << 13
STEP = 16384  # shingles sampled at a time
#: Members of a meeting drawn in the first round, about, and how many times more in each later one.
DRAWN, MORE = 32, 8
#: Weights of texts are compared in classes, each so many times the one before.
WIDTH = 1.06


class Shingles:
    """Distinct shingles of a block's texts that are not copies: key, text, tf; by key, then text."""

    def __init__(self, block: B.Block, copies: bytes):
        copy = np.zeros(len(block.ids), bool)
        copy[np.frombuffer(copies, np.int32)] = True
        starts, ends, first = words(block.data, block.offsets)
        w = hashes(block.data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        counts = np.diff(first)
        rank = np.repeat(np.arange(len(counts)), counts)
        factors = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
        n = max(0, len(w) - SHINGLE + 1)
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            total += w[k:k + n] * factors[k]
        whole = (rank[:n] == rank[SHINGLE - 1:SHINGLE - 1 + n]) & ~copy[rank[:n]] if n else np.zeros(0, bool)
        keys, texts = [total[whole]], [rank[:n][whole]]
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE) & ~copy)
        if len(short):
            sums = np.zeros(len(short), np.uint64)
            for k in range(SHINGLE - 1):
                has = counts[short] > k
                sums[has] += w[first[short[has]] + k] * factors[k]
            keys.append(sums)
            texts.append(short)
        key = mix(np.concatenate(keys)) >> np.uint64(64 - KEY_BITS)
        both = np.sort((key << np.uint64(16)) | np.concatenate(texts).astype(np.uint64))
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        self.tf = np.diff(np.concatenate([new, [len(both)]])).astype(np.float32)
        both = both[new]
        self.key, self.text = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint16)
        self.firsts = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(both) else new
        self.keys = self.key[self.firsts]
        self.df = np.diff(np.concatenate([self.firsts, [len(both)]]))

    def weighted(self, codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, key, log weight and frequency code of each shingle in the order of texts; where each text starts."""
        code = np.repeat(codes, self.df)
        weight = np.log(self.tf * idf[code].astype(np.float32))
        order = np.argsort(self.text, kind="stable")
        text = self.text[order].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
        return text, self.key[order], weight[order], code[order], begin


def idf_table(n_texts: int) -> np.ndarray:
    """Weight of each code of a document frequency."""
    df = 2.0 ** (np.arange(256) / 8)
    return np.clip(1 + 0.5 * np.log((1 + n_texts) / (1 + df)) / np.log(1 + max(1, n_texts)), 1, 1.5)


@functools.lru_cache(maxsize=1)
def _draws():
    rng = np.random.default_rng(20)
    u = 1 - rng.random((5, DRAWS))
    r, c, beta = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
    odd = mix(np.arange(1, K + 1, dtype=np.uint64)) | np.uint64(1)
    return [x.astype(np.float32) for x in (r, 1 / r, beta, np.log(c))], odd


def samples(key: np.ndarray, log_weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """ICWS samples (K, texts) of shingle vectors laid end to end."""
    (r, r1, beta, log_c), odd = _draws()
    shift = np.uint64(64 - DRAWS.bit_length() + 1)
    ends = np.concatenate([begin[1:], [len(key)]])
    out = np.empty((K, len(begin)), np.uint64)
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(ends, begin[first] + STEP, "right")))
        a, b = begin[first], ends[last - 1]
        k, w, at = key[a:b], log_weight[a:b], begin[first:last] - a
        place = np.arange(b - a, dtype=np.int64)
        for d in range(K):
            i = ((k * odd[d]) >> shift).astype(np.int64)
            step = r[i]
            t = np.floor(w * r1[i] + beta[i])
            log_a = log_c[i] - step * (t - beta[i] + np.float32(1))
            v = log_a.view(np.int32)
            v = v ^ ((v >> 31) & np.int32(0x7FFFFFFF))  # integers in the order of the floats
            best = np.minimum.reduceat((v.astype(np.int64) << 32) | place, at) & 0xFFFFFFFF
            out[d, first:last] = mix(k[best] ^ mix(t[best].astype(np.int64).view(np.uint64) + np.uint64(1)))
        first = last
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    """Band keys (texts, K / R)."""
    out = np.zeros((K // R, sampled.shape[1]), np.uint64)
    for k in range(K):
        out[k // R] = mix(out[k // R] * np.uint64(31) + sampled[k])
    return out.T.view(np.int64)


def _frequencies(n: int):
    def work(block: B.Block, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        s = Shingles(block, B.answers_of(right, 0))
        df = s.df.astype("<u2")
        yield B.messages(block.block, s.keys, KEY_BITS, n, KEY_BYTES, lambda a, b: df[a:b].tobytes())
    return work


def _codes(order: np.ndarray, starts: np.ndarray, lens: np.ndarray, more: list[bytes]) -> np.ndarray:
    df = np.frombuffer(b"".join(more), "<u2")[order].astype(np.int64)
    code = np.minimum(255, np.round(8 * np.log2(np.add.reduceat(df, starts)))).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(code, np.diff(np.concatenate([starts, [len(order)]])))
    return out


def _signatures(idf: np.ndarray):
    def work(block: B.Block, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        s = Shingles(block, B.answers_of(right, 0))
        text, key, weight, code, begin = s.weighted(np.frombuffer(B.answers_of(right, 1), np.uint8), idf)
        if len(begin):
            value = np.exp(weight.astype(np.float64))
            own = np.add.reduceat(np.where(code == 0, value, 0.0), begin) / np.add.reduceat(value, begin)  # what no other text holds
            yield pd.DataFrame({"id": block.ids[text[begin]], "bands": list(bands(samples(key, weight, begin))), "own": own})
    return work


def _vectors(idf: np.ndarray):
    def work(block: B.Block, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        wanted = np.frombuffer(B.answers_of(right, 2), np.int64)
        if not len(wanted):
            return
        s = Shingles(block, B.answers_of(right, 0))
        text, key, weight, code, begin = s.weighted(np.frombuffer(B.answers_of(right, 1), np.uint8), idf)
        raw = np.ascontiguousarray(key, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        value = np.exp(weight).astype("<f4")
        rows = [(int(block.ids[text[a]]), raw[a:b].tobytes() + value[a:b].tobytes() + code[a:b].tobytes())
                for a, b in zip(begin, [*begin[1:], len(key)]) if block.ids[text[a]] in wanted]
        yield pd.DataFrame(rows, columns=["id", "vector"])
    return work


def opened(vector: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, weights and frequency codes of a vector as ``_vectors`` lays it out: keys of six bytes in order, single floats, codes."""
    n = len(vector) // 11
    return B.unpacked(vector[:6 * n], 6), np.frombuffer(vector, "<f4", n, 6 * n).astype(np.float64), np.frombuffer(vector, np.uint8, n, 10 * n)


def weighted_jaccard(a: bytes, b: bytes) -> float:
    (ka, wa, _), (kb, wb, _) = opened(a), opened(b)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def rare_keys(vector: bytes, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Meeting points of a text (step, key, side, weight left from there on) and its weight: any two similar enough share one, on sides that meet.

    Similar texts overlap by similarity / (1 + similarity) of their joint weight. In the order from the rarest shingle to the most common
    one, the first shingle that two such texts share has that much of either one's weight from it on; so each text needs only the
    rarest shingles up to where less is left than the overlap with the lightest partner of a step of weights. Steps pair the
    two weights' classes (powers of WIDTH): the bound is near that of equal weights, a ninth of the weight at 0.8. In a step of two
    classes the lighter texts (side 0) meet the heavier ones (side 1) only; in a step of one class all meet (side 2).
    """
    key, weight, code = opened(vector)
    order = np.lexsort((key, code))
    key, weight = key[order], weight[order]
    total = weight.sum()
    left = total - np.concatenate([[0.0], np.cumsum(weight)[:-1]])  # from each shingle on
    mine = int(np.floor(np.log(total) / np.log(WIDTH)))
    reach = int(np.ceil(-np.log(similarity) / np.log(WIDTH)))
    steps, keys, sides, rest = [], [], [], []
    for other in range(mine - reach, mine + reach + 1):
        partner = max(WIDTH ** other, similarity * total) if other < mine else WIDTH ** other
        need = similarity / (1 + similarity) * (total + partner) * (1 - 1e-6)
        enough = left >= need
        some = key[enough]
        rest.append(left[enough])
        low, high = min(mine, other), max(mine, other)
        steps.append(np.full(len(some), (low << 16) + high - low, np.int64))
        keys.append(some)
        sides.append(np.full(len(some), 2 if mine == other else int(mine > other), np.int8))
    return np.concatenate(steps), np.concatenate(keys).astype(np.int64), np.concatenate(sides), np.concatenate(rest), float(total)


POINT = "band bigint, key bigint, id bigint, side tinyint, left double, total double"


def meeting(vectors: DataFrame, similarity: float) -> DataFrame:
    """The texts of ``vectors`` by their meeting points. Of points where the same texts meet the first in the order of rarity is left."""
    def points(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, v in zip(part.column("id").to_pylist(), part.column("vector")):
                step, key, side, left, total = rare_keys(v.as_py(), similarity)
                n = len(key)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(key), pa.array(np.full(n, i, np.int64)), pa.array(side), pa.array(left), pa.array(np.full(n, total))],
                                                 [c.split()[0] for c in POINT.split(", ")])

    rows = saved(vectors.select("id", "vector").mapInArrow(points, POINT), "points")
    who = F.struct("id", "side")
    met = rows.groupBy("band", "key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.min("side").alias("low"), F.max("side").alias("high"), F.count("*").alias("n"),
                                          F.bit_xor(F.xxhash64(who)).alias("x"), F.sum(F.xxhash64(who, F.lit(1)) % (1 << 40)).alias("y"), F.sum("left").alias("left"))
    met = met.filter("a <> z and (low = 2 or low <> high)").groupBy("band", "n", "a", "z", "x", "y").agg(F.max_by("key", F.struct("left", "key")).alias("key"))
    return rows.join(saved(met.select("band", "key"), "met"), ["band", "key"])


def verified(pairs: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """The pairs (id, rep) whose vectors are similar enough."""
    mine, theirs = vectors.withColumnRenamed("vector", "a"), vectors.select(F.col("id").alias("rep"), F.col("vector").alias("b"))

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = [weighted_jaccard(a.as_py(), b.as_py()) >= similarity for a, b in zip(part.column("a"), part.column("b"))]
            yield part.select(["id", "rep"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(mine, "id").join(theirs, "rep").select("id", "rep", "a", "b").mapInArrow(check, "id bigint, rep bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, class_id): the least id of the connected component, for ids with a link to a smaller one.

    ``links`` are pairs of ids, in any direction.
    """
    edges = saved(links.filter("id <> rep").select(F.greatest("id", "rep").alias("u"), F.least("id", "rep").alias("v")).distinct(), "edges")
    seen = None
    while True:
        # large star: neighbours above a node move to the least of the node's neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = saved(edges, "large-star")
        # small star: a node and its smaller neighbours move to the least of those
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = saved(moved.select("e.u", "e.v").filter("u <> v").distinct(), "small-star")
        state = edges.agg(F.count("*"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
        seen = state


def linked(members: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """(id, class_id) of the classes of all similar pairs that meet in a bucket; ``members`` has band, key, id, rep.

    First each member is compared with its bucket's representative, which makes one class of a text and its
    edits. In buckets that still have several classes members meet by their rarest shingles only (``rare_keys``): similar ones share one,
    edits that differ too much have theirs for themselves. Texts that meet there are compared until each pair was compared or is
    in one class: those outside a meeting's largest class are drawn, more each round, and compared with
    all of other classes. So the classes are those of all pairs.
    """
    pair = (F.greatest("id", "rep").alias("id"), F.least("id", "rep").alias("rep"))
    tested = saved(members.filter("id <> rep").select(*pair).distinct(), "pairs")
    found = components(saved(verified(tested, vectors, similarity), "links"))
    labelled = members.join(found, "id", "left").select("band", "key", "id", F.coalesce("class_id", "id").alias("class_id"))
    labelled = saved(labelled, "labelled")
    several = labelled.groupBy("band", "key").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a <> b").select("band", "key")
    apart = saved(labelled.join(saved(several, "several"), ["band", "key"]).select("id").distinct(), "apart")
    if apart.isEmpty():
        return found
    members, most = saved(meeting(vectors.join(apart, "id"), similarity).withColumn("done", F.lit(False)), "meeting"), DRAWN
    while True:
        classed = members.join(found, "id", "left").select("band", "key", "id", "side", "left", "total", "done", F.coalesce("class_id", "id").alias("class_id"))
        classed = saved(classed, "classed")
        heads = classed.groupBy("band", "key", "class_id").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("open"))
        open_buckets = heads.groupBy("band", "key").agg(F.max(F.struct("n", "class_id", "open")).alias("top"), F.sum("open").alias("open"))
        open_buckets = open_buckets.select("band", "key", F.col("top.class_id").alias("largest"), (F.col("open") - F.col("top.open")).alias("open"))
        open_buckets = saved(open_buckets.filter("open > 0"), "open-buckets")  # so that a bucket of many members can be split below
        if open_buckets.isEmpty():
            return found
        share = F.pmod(F.xxhash64("id", "band"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = ~F.col("done") & (F.col("class_id") != F.col("largest")) & (share * F.col("open") < most)
        members = saved(classed.join(open_buckets, ["band", "key"]).select("band", "key", "id", "side", "left", "total", "class_id", "done", drawn.alias("drawn")), "members")
        pivots = saved(members.filter("drawn").select("band", "key", *(F.col(c).alias(f"rep_{c}") for c in ("id", "side", "left", "total", "class_id"))), "pivots")
        # where two similar texts meet first, each has the weight that they must share from there on
        others = members.filter("not done").join(pivots, ["band", "key"]).filter(
            "class_id <> rep_class_id and (side = 2 or side <> rep_side) and (not drawn or id > rep_id)"
            f" and least(left, rep_left) >= {similarity / (1 + similarity) * (1 - 1e-6)} * (total + rep_total)").withColumnRenamed("rep_id", "rep")
        new = saved(others.select(*pair).distinct().join(tested, ["id", "rep"], "left_anti"), "pairs")
        more = saved(verified(new, vectors, similarity), "links")
        tested = tested.unionByName(new)
        if not more.isEmpty():
            found = components(found.select("id", F.col("class_id").alias("rep")).unionByName(more))
        members, most = members.select("band", "key", "id", "side", "left", "total", F.expr("done or drawn").alias("done")), MORE * most


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id and class_id (the least id of the class) for every row."""
    table, n = B.build(docs, id_col, text_col)
    firsts = saved(B.first_ids(table), "firsts")
    idf = idf_table(firsts.count())
    answers = saved(B.later_copies(table, firsts), "copies")
    sent = B.with_answers(table, answers, _frequencies(n), B.MESSAGE)
    answers = answers.unionByName(saved(B.reduced(sent, 1, KEY_BYTES, _codes, np.ndarray.tobytes), "frequencies"))
    signatures = saved(B.with_answers(table, answers, _signatures(idf), "id bigint, bands array<bigint>, own double"), "signatures")

    marks = signatures.select("id", "own", F.posexplode("bands").alias("band", "key"))
    rank = F.struct("own", F.xxhash64("id", "band"), "id")  # who has the least of its own is nearest to the others
    buckets = marks.groupBy("band", "key").agg(F.min_by("id", rank).alias("rep"), F.min("id").alias("low"), F.max("id").alias("high"))
    buckets = saved(buckets.filter("low <> high").select("band", "key", "rep"), "buckets")
    members = saved(marks.drop("own").join(buckets, ["band", "key"]), "members")
    wanted = members.select("id").distinct()

    def lists(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"block": part["block"], "kind": 2, "p": 0, "answer": [np.array(x, np.int64).tobytes() for x in part["ids"]]})

    where = table.select("block", F.explode("ids").alias("id")).join(wanted, "id").groupBy("block").agg(F.collect_set("id").alias("ids"))
    answers = answers.unionByName(where.mapInPandas(lists, B.ANSWER))
    vectors = saved(B.with_answers(table, answers, _vectors(idf), "id bigint, vector binary").dropDuplicates(["id", "vector"]), "vectors")

    found = linked(members, vectors, similarity)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _labelled(rows, table, firsts, found, id_col)


def _labelled(rows: DataFrame, table: DataFrame, firsts: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    own = table.select(F.explode(F.arrays_zip("ids", "digests")).alias("r")).select(F.col("r.ids").alias("id"), F.col("r.digests").alias("digest"))
    own = own.join(firsts, "digest").select("id", F.col("first"))
    found = found.select(F.col("id").alias("first"), "class_id")
    out = own.join(found, "first", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "first").alias("class_id"))
    missing = rows.filter("id is null").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(missing)


#: The classes in SQL, from all pairs of texts that share a shingle: what the bands look for.
SQL = f"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS t, MIN(doc_id) AS id FROM documents WHERE doc_id IS NOT NULL GROUP BY 1
), split AS (
  SELECT id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts
), shingles AS (
  SELECT id, s, COUNT(*) AS tf FROM (
    SELECT id, UNNEST(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(len(w) - {SHINGLE - 1}), lambda i: array_to_string(w[(i + 1):(i + {SHINGLE})], ' '))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split) GROUP BY id, s
), frequencies AS (
  SELECT s, COUNT(*) AS df, (SELECT COUNT(*) FROM texts) AS n FROM shingles GROUP BY s
), weighted AS (
  SELECT id, s, tf * LEAST(1.5, GREATEST(1.0, 1 + 0.5 * ln((1 + n) / (1 + pow(2.0, ROUND(8 * log2(df)) / 8))) / ln(1 + n))) AS w FROM shingles JOIN frequencies USING (s)
), sums AS (SELECT id, SUM(w) AS total FROM weighted GROUP BY id),
shared AS (
  SELECT a.id AS u, b.id AS v, SUM(LEAST(a.w, b.w)) AS low FROM weighted a JOIN weighted b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN sums x ON x.id = u JOIN sums y ON y.id = v WHERE low / (x.total + y.total - low) >= {SIMILARITY}
), edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(id, label) AS (SELECT id, id FROM texts UNION SELECT b.v, r.label FROM reach r JOIN edges b ON b.u = r.id),
classes AS (SELECT id, MIN(label) AS class_id FROM reach GROUP BY id)
SELECT doc_id, class_id FROM documents LEFT JOIN texts ON coalesce(text, '') = t AND doc_id IS NOT NULL LEFT JOIN classes USING (id)
"""
