"""Suffix-array dedup: depth-limited radix sort.

Suffixes of all texts (as UTF-8 bytes) are ordered through ``WINDOW`` bytes only, by passes
over digits, most significant first; suffixes that are alone in their group leave the order
after each pass, and the groups that are equal through the last digit are exactly the
repeated windows. Digits are fingerprints of bytes, so a pass is one exchange by digit range
and one sort inside each range:

0. the whole text (16-byte digest): a text that equals one with a smaller id is settled;
1. the leading block of the window: of its 24-byte blocks the one with the least hash.
   Neighbouring suffixes share it, so a run of suffixes sends one digit (about one in
   fourteen bytes sends any), and equal windows have equal digits;
2. all bytes of the window (64 bits), for suffixes whose first digit another document has.
   Two suffixes are taken as equal when both digits agree.

For each digit a block keeps its least document id; the range answers, per digit sent,
whether a smaller id has it too.

Result of ``removed``: every byte covered by a window that also starts in a document with a
smaller id is removed, judged on the input. Rows: null text is empty; a null id is neither
smaller nor larger, so such a row keeps all; rows that share an id do not remove each other;
repeated rows each get their own result; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .bytewise import mix, powers, prefix, runs
from .scratch import saved

WINDOW = 50
LEAD = 24
SPAN = WINDOW - LEAD + 1  # leading blocks of a window
SLICE = (1 << 19) - 64  # suffixes whose digits are made at a time
LEAD_BITS, LEAD_BYTES = 48, 5


def _least(x: np.ndarray) -> np.ndarray:
    """Minimum of SPAN neighbours, by doubling."""
    n, width = len(x) - SPAN + 1, 1
    while 2 * width <= SPAN:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[SPAN - width:SPAN - width + n])


def _fingerprints(data: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of the k bytes from each position."""
    sums, (_, down) = prefix(data), powers(len(data) + 1)
    return mix((sums[k:] - sums[:-k]) * down[:len(data) - k + 1])


class Suffixes:
    """Suffixes of a block's texts that have a whole window, in runs of equal first digit."""

    def __init__(self, block: B.Block, settled: bytes):
        self.block = block
        lens = np.diff(block.offsets)
        self.settled = np.zeros(len(lens), bool)
        self.settled[np.frombuffer(settled, np.int32)] = True
        use = ~self.settled & (lens >= WINDOW)
        first, count = block.offsets[:-1][use], lens[use] - WINDOW + 1
        edge = np.zeros(len(block.data) + 1, np.int8)
        edge[first] = 1
        edge[first + count] -= 1
        starts_here = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        starts, sizes, digits = [], [], []
        for s in range(0, len(block.data) - WINDOW + 1, SLICE):
            at = np.flatnonzero(starts_here[s:s + SLICE])
            if not len(at):
                continue
            lead = _least(_fingerprints(block.data[s:s + SLICE + WINDOW - 1], LEAD))[at]
            new = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (at[1:] != at[:-1] + 1)]))
            starts.append(at[new] + s)
            sizes.append(np.diff(np.concatenate([new, [len(at)]])))
            digits.append(lead[new])
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        digit = mix(np.concatenate(digits)) >> np.uint64(64 - LEAD_BITS) if digits else np.zeros(0, np.uint64)
        rank = np.searchsorted(block.offsets, self.starts, "right") - 1
        self.digits, self.inverse = np.unique(digit, return_inverse=True)
        both = np.unique((digit << np.uint64(16)) | rank.astype(np.uint64))  # digit and text
        ids = block.ids[(both & np.uint64(0xFFFF)).astype(np.int64)]
        first = np.searchsorted(both >> np.uint64(16), self.digits)
        self.shared_here = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(ids) else np.zeros(0, bool)

    def go_on(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes whose first digit another document has: positions and second digits."""
        chosen = (self.shared_here | elsewhere)[self.inverse]
        starts, sizes = self.starts[chosen], self.sizes[chosen]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
        out = np.empty(len(at), np.uint64)
        for s in range(0, len(self.block.data) - WINDOW + 1, SLICE):
            a, b = np.searchsorted(at, [s, s + SLICE])
            if a < b:
                data = self.block.data[s:s + SLICE + WINDOW - 1]
                sums, (_, down) = prefix(data), powers(len(data) + 1)
                p = at[a:b] - s
                out[a:b] = mix((sums[p + WINDOW] - sums[p]) * down[p])
        return at, out


class Groups:
    """Suffixes of a block that went on, grouped by second digit, with the least id of each group."""

    def __init__(self, block: B.Block, at: np.ndarray, digits: np.ndarray):
        self.rank = np.searchsorted(block.offsets, at, "right") - 1
        self.digits, first, self.inverse = np.unique(digits, return_index=True, return_inverse=True)  # first: texts are in the order of ids
        self.first_rank = self.rank[first]
        self.least = block.ids[self.first_rank]


def _first_pass(n: int):
    def work(block: B.Block, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        s = Suffixes(block, B.answers_of(right, 0))
        yield B.messages(block.block, s.digits, LEAD_BITS, n, LEAD_BYTES, lambda a, b: b"")
    return work


def _in_other_blocks(order: np.ndarray, starts: np.ndarray, lens: np.ndarray, more: list[bytes]) -> np.ndarray:
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    out = np.empty(len(order), bool)
    out[order] = np.repeat(sizes > 1, sizes)
    return out


def _second_pass(n: int):
    def work(block: B.Block, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        s = Suffixes(block, B.answers_of(right, 0))
        g = Groups(block, *s.go_on(B.unbits(right, 1, s.digits, LEAD_BITS, n)))

        def ids(a: int, b: int) -> bytes:
            some, which = np.unique(g.first_rank[a:b], return_inverse=True)
            return np.array([len(some)], np.int64).tobytes() + block.ids[some].tobytes() + which.astype(np.uint16).tobytes()

        yield B.messages(block.block, g.digits, 64, n, 8, ids)
    return work


def _smaller_elsewhere(order: np.ndarray, starts: np.ndarray, lens: np.ndarray, more: list[bytes]) -> np.ndarray:
    parts = []
    for raw in more:
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        parts.append(np.frombuffer(raw, np.int64, k, 8)[np.frombuffer(raw, np.uint16, -1, 8 + 8 * k)])
    ids = np.concatenate(parts)
    ranked = ids[order]
    least = np.repeat(np.minimum.reduceat(ranked, starts), np.diff(np.concatenate([starts, [len(order)]])))
    out = np.empty(len(order), bool)
    out[order] = ranked > least
    return out


def _result(n: int, id_col: str, with_kept: bool):
    def work(block: B.Block, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        s = Suffixes(block, B.answers_of(right, 0))
        at, digits = s.go_on(B.unbits(right, 1, s.digits, LEAD_BITS, n))
        g = Groups(block, at, digits)
        gone = B.unbits(right, 2, g.digits, 64, n)[g.inverse] | (block.ids[g.rank] > g.least[g.inverse])
        edge = np.zeros(len(block.data) + 1, np.int32)
        edge[at[gone]] += 1
        edge[at[gone] + WINDOW] -= 1
        covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
        lens = np.diff(block.offsets)
        for r in np.flatnonzero(s.settled & (lens >= WINDOW)):
            covered[block.offsets[r]:block.offsets[r + 1]] = True
        removed = np.diff(np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])[block.offsets])
        first, last = runs(covered, block.offsets)
        spans = np.diff(np.searchsorted(first, block.offsets))
        hashes, kept = [], []
        for r, (a, b) in enumerate(zip(block.offsets[:-1], block.offsets[1:])):
            rest = block.data[a:b] if not removed[r] else block.data[a:b][~covered[a:b]]
            hashes.append(hashlib.sha256(rest.tobytes()).hexdigest())
            if with_kept:
                kept.append(rest.tobytes())
        out = {id_col: block.ids, "n_bytes": lens, "n_removed": removed, "n_spans": spans, "kept_sha256": hashes}
        yield pd.DataFrame(out | ({"kept": kept} if with_kept else {}))
    return work


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, and on request the kept bytes."""
    table, n = B.build(docs, id_col, text_col)
    answers = saved(B.later_copies(table, saved(B.first_ids(table), "firsts")), "copies")
    sent = B.with_answers(table, answers, _first_pass(n), B.MESSAGE)
    answers = answers.unionByName(saved(B.reduced(sent, 1, LEAD_BYTES, _in_other_blocks, B.bits), "leads"))
    sent = B.with_answers(table, answers, _second_pass(n), B.MESSAGE)
    answers = answers.unionByName(saved(B.reduced(sent, 2, 8, _smaller_elsewhere, B.bits), "windows"))
    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    out = B.with_answers(table, answers, _result(n, id_col, with_kept), schema + (", kept binary" if with_kept else ""))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rest = docs.filter(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.alias("kept")] if with_kept else []))
    return out.unionByName(rest)


#: The same result in SQL, from all windows of all texts as hexadecimal text.
SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT row, doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT *, UNNEST(range(n - 49)) AS i FROM docs WHERE n >= 50)
), flagged AS (
  SELECT row, i FROM (SELECT row, doc_id, i, MIN(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < doc_id
), stepped AS (
  SELECT row, i, CASE WHEN i <= LAG(i) OVER (PARTITION BY row ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM flagged
), runs AS (
  SELECT row, MIN(i) AS a, MAX(i) + 50 AS b FROM (SELECT row, i, SUM(new) OVER (PARTITION BY row ORDER BY i) AS run FROM stepped) GROUP BY row, run
), cuts AS (
  SELECT row, COUNT(*) AS n_spans, SUM(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY row
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(range(n_spans + 1), lambda k:
    substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * ends[k] + 1 END, 2 * (CASE WHEN k = n_spans THEN n ELSE starts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE ends[k] END))), '')) END) AS kept_sha256
FROM docs LEFT JOIN cuts USING (row)
"""
