"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives counts; counts give a vector of transformed statistics. For each language
and source the minimum covariance determinant (MCD) of the vectors is estimated over all
their rows: from deterministic starts (median with MAD scales, spatial signs, hyperbolic
tangents), concentration steps keep the share of rows nearest by the current estimate and
estimate again; the start with the least determinant wins, and one reweighting follows.
A document is rejected when its squared Mahalanobis distance passes a chi-square quantile.

Every step is a sum over all rows of a group with partial sums before the shuffle; only
estimates (a few numbers for each group) are joined back. The distance that holds the
nearest share is an approximate percentile (rank error 1/10,000).

Rows: null text has no words; documents that fail the base rules are not in the estimates
and are not kept; a group with under ``MIN_GROUP`` rows is estimated with the other small
ones of its language, and if they are too few, of all languages; under ``MIN_GROUP`` rows
there too, the method rejects nothing. A null language or source is a value of its own.
Coordinates that do not vary get the floor variance, so a constant one rejects only what
clearly departs from it. Repeated rows count as often as they stand; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import SPACE, flat, hashes, mix, runs, words
from .scratch import saved
from .tokens import batches

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
SLICE_BYTES = 1 << 20
SHARE = 0.75  # of a group's rows that the determinant is minimised over
STEPS = 4
MIN_GROUP = 50
REJECT = 1 - 1e-5  # chi-square quantile
REWEIGHT = 0.975
#: Least standard deviation of each transformed statistic.
FLOORS = (0.25, 0.08, 0.05, 0.15, 0.15)
P = len(FLOORS)
STARTS = ("median", "signs", "tanh")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[offsets])


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal an earlier one, and which equal any other one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    return later, shared


def text_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of COUNTS for each of the texts that lie end to end."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(n, np.int64) for _ in COUNTS]
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    space = SPACE[data]
    word_chars = _per_text(((data & 0xC0) != 0x80) & ~space, offsets)
    n_symbols = _per_text(_IS_SYMBOL[data], offsets)

    doc = np.repeat(np.arange(n), n_words)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    if len(starts) >= 3:
        w = hashes(data, starts, ends)
        at = np.flatnonzero(doc[2:] == doc[:-2])
        keys = mix(w[at] + np.uint64(3) * w[at + 1] + np.uint64(0x9E3779B97F4A7C15) * w[at + 2]) ^ salt[doc[at]]
        shared = at[_again(keys)[1]]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[shared + k] = True
        n_repeat = np.bincount(doc[covered], minlength=n)
    else:
        n_repeat = np.zeros(n, np.int64)

    line_starts, line_ends = runs(data != 0x0A, offsets)  # lines with a word are never empty
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    later = _again(hashes(data, line_starts, line_ends) ^ salt[line_doc])[0] if len(line_starts) else np.zeros(0, bool)
    return [n_words, word_chars, n_symbols, np.bincount(line_doc, minlength=n), np.bincount(line_doc[later], minlength=n), n_repeat]


def base_counts(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The kept columns, then one column for each of COUNTS."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            data, offsets = flat(b.columns[-1])
            for a, z in batches(data, offsets, SLICE_BYTES):  # bounds the arrays made for the bytes
                counts = text_counts(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), *(pa.array(x, pa.int64()) for x in counts)],
                                                 names=[*keep, *COUNTS])

    narrow = docs.select(*keep, text_col)
    fields = "".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}, " for c in keep)
    return narrow.mapInArrow(count, fields + ", ".join(f"{c} bigint" for c in COUNTS))


def statistics() -> list[Column]:
    """Transformed statistics of a row of counts with words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]


def chi2_cdf(x: float, k: float) -> float:
    """Chi-square distribution function, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > total * 1e-16:
        i += 1
        term *= z / i
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def consistency(share: float, k: int) -> float:
    """What a covariance of the nearest ``share`` is multiplied by, to fit normal data."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


Z = [f"z{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Parts that the rows of a group are dealt to when they meet the group's estimates.
SALTS = 32
ESTIMATE = "g string, start string, n bigint, mu array<double>, inv array<double>, logdet double"


def _moments(weighted: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), F.array(*(F.avg(c) for c in weighted)).alias("m1"),
            F.array(*(F.avg(weighted[i] * weighted[j]) for i, j in PAIRS)).alias("m2")]


def _square(values) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, values):
        out[i, j] = out[j, i] = v
    return out


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Means, inverse covariances and log determinants from the moments of each (g, start)."""
    floor = np.diag(np.square(FLOORS))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                mu = np.array(r.m1, float)
                cov = (_square(r.m2) - np.outer(mu, mu)) * factor + floor
                rows.append((r.g, r.start, r.n, mu.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(rows, columns=["g", "start", "n", "mu", "inv", "logdet"])

    return moments.mapInPandas(solve, ESTIMATE)


def _distance() -> Column:
    gaps = [F.col(z) - F.col("mu")[i] for i, z in enumerate(Z)]
    return sum(((1 if i == j else 2) * F.col("inv")[i * P + j] * gaps[i] * gaps[j] for i, j in PAIRS), F.lit(0.0))


def _dealt(estimates: DataFrame) -> DataFrame:
    """A copy of each estimate for every salt: rows of a hot group meet it in many tasks."""
    return estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _first_estimates(rows: DataFrame) -> DataFrame:
    """One row for each group and start."""
    middle = rows.groupBy("g").agg(F.array(*(F.percentile_approx(z, 0.5, 10000) for z in Z)).alias("mid"))
    middle = saved(middle, "medians")
    gaps = rows.join(_dealt(middle), ["g", "salt"])
    scale = gaps.groupBy("g").agg(F.array(*(
        F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(z) - F.col("mid")[i]), 0.5, 10000), F.lit(FLOORS[i])) for i, z in enumerate(Z))).alias("mad"))
    gaps = gaps.join(_dealt(saved(scale, "scales")), ["g", "salt"])
    unit = [(F.col(z) - F.col("mid")[i]) / F.col("mad")[i] for i, z in enumerate(Z)]
    norm = F.greatest(F.sqrt(sum((u * u for u in unit), F.lit(0.0))), F.lit(1e-9))
    sums = gaps.groupBy("g").agg(
        F.count("*").alias("n"), F.first("mid").alias("mid"), F.first("mad").alias("mad"),
        F.array(*(F.avg(unit[i] * unit[j] / (norm * norm)) for i, j in PAIRS)).alias("signs"),
        F.array(*(F.avg(F.tanh(unit[i]) * F.tanh(unit[j])) for i, j in PAIRS)).alias("tanh"))
    floor = np.diag(np.square(FLOORS))

    def starts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                d = np.diag(np.array(r.mad, float))
                for start in STARTS:
                    shape = np.eye(P)
                    if start != "median":
                        raw = _square(getattr(r, start)) + 1e-6 * np.eye(P)
                        s = 1 / np.sqrt(np.diag(raw))
                        shape = raw * np.outer(s, s)
                    cov = d @ shape @ d + floor
                    rows.append((r.g, start, r.n, list(map(float, r.mid)), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(rows, columns=["g", "start", "n", "mu", "inv", "logdet"])

    return sums.mapInPandas(starts, ESTIMATE)


def fit(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Reweighted MCD estimates (columns of ESTIMATE) for each group ``g`` of rows with z0, z1, ..."""
    now = saved(_first_estimates(rows), "mcd-start")
    for k in range(steps):
        near = rows.join(_dealt(now), ["g", "salt"]).select("g", "salt", "start", *Z, _distance().alias("d2"))
        edge = near.groupBy("g", "start").agg(F.percentile_approx("d2", share, 10000).alias("edge"))
        kept = near.join(_dealt(saved(edge, f"edge-{k}")), ["g", "salt", "start"]).filter("d2 <= edge")
        now = saved(_estimates(kept.groupBy("g", "start").agg(*_moments([F.col(z) for z in Z])), consistency(share, P)), f"mcd-{k}")
    best = now.groupBy("g").agg(F.min_by(F.struct("start", "mu", "inv"), F.struct("logdet", "start")).alias("b")).select("g", "b.*")
    inside = rows.join(_dealt(saved(best, "best")), ["g", "salt"]).filter(_distance() <= chi2_quantile(REWEIGHT, P))
    return saved(_estimates(inside.groupBy("g", "start").agg(*_moments([F.col(z) for z in Z])), consistency(REWEIGHT, P)), "mcd")


def grouped(counts: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """``counts`` with z0.. and the group ``g`` that a row is judged by (null: none)."""
    rows = counts.withColumns(dict(zip(Z, statistics()))).withColumn("_own", F.to_json(F.struct(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))))
    rows = rows.withColumn("_lang", F.to_json(F.struct(F.col(lang_col).alias("lang"), F.lit(1).alias("rest"))))
    own = rows.filter("not base_failed").groupBy("_own", "_lang").agg(F.count("*").alias("_n"))
    by_lang = own.filter(F.col("_n") < MIN_GROUP).groupBy("_lang").agg(F.sum("_n").alias("_n_lang"))
    rest = by_lang.filter(F.col("_n_lang") < MIN_GROUP).agg(F.sum("_n_lang").alias("_n_rest"))
    names = own.join(by_lang, "_lang", "left").join(F.broadcast(rest), F.lit(True), "left")  # rest is one row
    names = names.select("_own", F.when(F.col("_n") >= MIN_GROUP, F.col("_own")).when(F.col("_n_lang") >= MIN_GROUP, F.col("_lang"))
                         .when(F.col("_n_rest") >= MIN_GROUP, F.lit("rest")).alias("g"))
    return rows.join(names, "_own", "left").drop("_own", "_lang")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
           reject: float = REJECT) -> DataFrame:
    """Counts, base_failed, the squared distance (null where none applies) and kept for every document."""
    counts = base_counts(docs, (id_col, lang_col, source_col), text_col)
    counts = counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = grouped(saved(counts, "counts"), lang_col, source_col)
    rows = saved(rows.withColumn("salt", F.pmod(F.xxhash64(id_col, "n_words", "word_chars"), F.lit(SALTS)).cast("int")), "statistics")
    estimates = fit(rows.filter("not base_failed and g is not null"))
    far = rows.join(_dealt(estimates.select("g", "mu", "inv")), ["g", "salt"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return far.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~F.coalesce(F.col("distance") > chi2_quantile(reject, P), F.lit(False))).alias("kept"), "distance")
