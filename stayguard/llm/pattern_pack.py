"""Best-fit packing: pattern packing by non-negative least squares.

1. Texts become pieces of at most ``max_len`` token ids (the closing id included).
2. The histogram of piece lengths (at most ``max_len`` rows, whatever the corpus) is all
   that reaches the driver. Lengths are binned; patterns are multisets of at most
   ``max_parts`` bins that fill a sequence; non-negative least squares fits how often each
   pattern repeats so that the patterns use up the histogram.
3. Counts are rounded down and the patterns filled with exact lengths; what is left goes,
   longest first, into the tightest gap, or into new sequences.
4. The plan, at most a few slots for each length, gives each piece its place by the
   piece's rank among those of its length. Ranks are counted in salted groups, so a length
   that holds a third of all pieces is spread over many tasks.

Rows: null text is empty and packs as the closing id alone; repeated rows are separate
documents; ties in rank are broken by id, piece and content; an empty table gives an empty
result; other columns are ignored by ``pieces`` and kept by ``pack``.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bytewise import flat
from .scratch import saved
from .tokens import ChunkTokenizer, batches

MAX_LEN = 2048
END_ID = 0
#: Histogram bins for the patterns, and the most documents in a pattern.
BINS = 64
MAX_PARTS = 4
#: Shares of the fitted counts that rounding may keep; the rest is packed as residual.
SHARES = (1.0, 0.7, 0.3)
#: Rows that one ranking group is meant to hold.
RANK_ROWS = 250_000


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str, end_id: int) -> ChunkTokenizer:
    return ChunkTokenizer(path, end_id)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, ids_crc32, and the ids themselves on request."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, end_id)
        for batch in batches_in:
            data, offsets = flat(batch.column(1))
            for first, last in batches(data, offsets):
                ids, at = tokenizer.encode(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                ids = ids.astype("<u4", copy=False)
                n = np.diff(at)
                parts = -(-n // max_len)
                row = np.repeat(np.arange(last - first), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * max_len
                length = np.minimum(n[row] - start, max_len)
                begin = at[row] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * b:4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist())]
                columns = [batch.column(0).slice(first, last - first).take(pa.array(row)), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    where = np.arange(int(length.sum())) + np.repeat(begin - np.cumsum(length) + length, length)
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32),
                                                            pa.array(ids[where].astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(id_col, text_col).mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def patterns(bins: int = BINS, max_parts: int = MAX_PARTS) -> list[tuple[int, ...]]:
    """Multisets of up to ``max_parts`` bins (descending) whose sizes add up to a full sequence."""
    def grow(left: int, most: int, parts: int):
        if left == 0:
            yield ()
        elif parts:
            for b in range(min(left, most), -(-left // parts) - 1, -1):
                for rest in grow(left - b, b, parts - 1):
                    yield (b, *rest)
    return list(grow(bins, bins, max_parts))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares of ``a @ x`` to ``b`` with x not negative, by an active set of columns."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = 0
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x += step * (trial - x)
            free &= x > 1e-12 * max(1.0, x.max())
            x[~free] = 0
    return x


def _fill(have: np.ndarray, pattern: tuple[int, ...], count: int, width: int, max_len: int, out: Counter) -> None:
    """Give ``count`` copies of a pattern exact lengths: the longest left in each bin, then the best fit."""
    while count > 0:
        left, chosen = have.copy(), []
        for k, b in enumerate(pattern):
            low, room = (b - 1) * width, max_len - sum(chosen)
            high = min(room, max_len if k == len(pattern) - 1 else b * width)
            some = np.flatnonzero(left[low + 1:high + 1])
            if not len(some):
                return
            chosen.append(low + 1 + int(some[-1]))
            left[chosen[-1]] -= 1
        times = min(count, *(int(have[n]) // k for n, k in Counter(chosen).items()))
        for n in chosen:
            have[n] -= times
        out[tuple(chosen)] += times
        count -= times


def plan(histogram: dict[int, int], max_len: int = MAX_LEN, bins: int = BINS, max_parts: int = MAX_PARTS,
         shares: tuple[float, ...] = SHARES) -> Counter:
    """Sequences as tuples of piece lengths, with their counts, that use up the histogram exactly.

    Rounding keeps some share of each pattern's count; the share that needs fewest sequences wins.
    """
    return min((_plan(histogram, max_len, bins, max_parts, s) for s in shares), key=lambda made: sum(made.values()))


def _plan(histogram: dict[int, int], max_len: int, bins: int, max_parts: int, share: float) -> Counter:
    have = np.zeros(max_len + 1, np.int64)
    for n, k in histogram.items():
        have[n] += k
    width = -(-max_len // bins)
    bins = -(-max_len // width)
    made: Counter = Counter()
    if have[max_len]:
        made[(max_len,)] += int(have[max_len])
        have[max_len] = 0
    binned = np.bincount(-(-np.arange(max_len + 1) // width), weights=have, minlength=bins + 1)[1:bins + 1]
    kinds = patterns(bins, max_parts)
    uses = np.zeros((bins, len(kinds)))
    for k, kind in enumerate(kinds):
        for b in kind:
            uses[b - 1, k] += 1
    counts = nnls(uses, binned) if binned.any() else np.zeros(len(kinds))
    counts = np.floor(counts * share)
    for k in sorted(np.flatnonzero(counts).tolist(), key=lambda k: (len(kinds[k]), kinds[k])):
        _fill(have, kinds[k], int(counts[k]), width, max_len, made)

    gaps: list[Counter] = [Counter() for _ in range(max_len + 1)]
    open_gaps = np.zeros(max_len + 1, bool)
    for kind, k in made.items():
        gaps[max_len - sum(kind)][kind] += k
    open_gaps[:] = [bool(x) for x in gaps]
    for n in range(max_len, 0, -1):
        left = int(have[n])
        while left:
            fit = np.flatnonzero(open_gaps[n:])
            if len(fit):
                gap = n + int(fit[0])
                kind, k = next(iter(gaps[gap].items()))
                times, copies = min(left, k), 1
                if times == k:
                    del gaps[gap][kind]
                    open_gaps[gap] = bool(gaps[gap])
                else:
                    gaps[gap][kind] -= times
            else:
                gap, kind, copies = max_len, (), min(left, max_len // n)
                times = left // copies
            kind = kind + (n,) * copies
            gaps[gap - n * copies][kind] += times
            open_gaps[gap - n * copies] = True
            left -= times * copies
    return Counter({kind: k for g in gaps for kind, k in g.items()})


def slots(made: Counter, max_len: int = MAX_LEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (length << 44 | first rank), first sequence and offset of runs of places, by key."""
    rows, first, ranks = [], 0, Counter()
    for kind, k in made.items():
        offset = 0
        for n in kind:
            rows.append(((n << 44) + ranks[n], first, offset))
            ranks[n] += k
            offset += n
        first += k
    rows.sort()
    keys, sequences, offsets = zip(*rows) if rows else ((), (), ())
    return np.array(keys, np.int64), np.array(sequences, np.int64), np.array(offsets, np.int64)


def pack(items: DataFrame, order: list[str], length_col: str = "length", max_len: int = MAX_LEN) -> DataFrame:
    """``items`` with sequence_id and offset. ``order`` names columns that break ties in rank.

    ``items`` is read three times, so it should be a written table.
    """
    by_length = items.groupBy(F.col(length_col).alias("n")).count().collect()  # at most max_len rows
    histogram = {int(r["n"]): int(r["count"]) for r in by_length}
    salts = max(16, -(-sum(histogram.values()) // RANK_ROWS))
    keys, firsts, offs = slots(plan(histogram, max_len), max_len)
    table = items.sparkSession.sparkContext.broadcast((keys, firsts, offs))  # a few rows for each length

    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    per = salted.groupBy(length_col, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(length_col, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order)))
    ranked = ranked.join(per, [length_col, "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    columns = items.columns
    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, offs = table.value
        for batch in batches_in:
            key = (batch.column(length_col).to_numpy(zero_copy_only=False) << 44) + batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(firsts[at] + key - keys[at]), pa.array(offs[at])],
                names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "_rank").mapInArrow(place, schema)


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """Cut, write the pieces, and pack them."""
    table = saved(pieces(docs, path, id_col, text_col, max_len), "pieces")
    return pack(table, [id_col, "piece", "start", "ids_crc32"], max_len=max_len)
