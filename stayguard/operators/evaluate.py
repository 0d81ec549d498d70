"""Model evaluation without collecting scores.

Ranking metrics are computed on the table of *distinct scores* per group
(``groupBy(group, score)`` with partial aggregation, so a heavily tied score is
pre-combined per task), cumulated with the distributed ``global_order``.
Top-k metrics rank rows with a unique tie-break (score desc, id asc).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import global_order
from .select import exact_quantiles, top_sums


def _y(label: str) -> Column:
    return F.col(label).cast("int")


def score_table(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Distinct scores per group with positive / negative counts."""
    g = list(groups or [])
    return df.groupBy(*g, score).agg(
        F.sum(_y(label)).cast("long").alias("pos"),
        F.sum(1 - _y(label)).cast("long").alias("neg"),
    )


def roc_auc(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Rank-sum AUC (ties count one half). NULL when a group has one class only."""
    g = list(groups or [])
    st = score_table(df, label, score, g)
    cum = global_order(st, [F.col(score).asc()], "_k", cumulative={"cneg": F.col("neg")}, partition_by=g)
    below = F.col("cneg") - F.col("neg")
    out = cum.groupBy(*g).agg(
        F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")))
    return out.select(*g, auc.alias("roc_auc"))


def cumulated_scores(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Distinct scores from the highest, with running tp and fp and the totals _P and _N of the group."""
    return global_order(score_table(df, label, score, groups), [F.col(score).desc()], "threshold_rank",
                        cumulative={"tp": F.col("pos"), "fp": F.col("neg")}, partition_by=list(groups or []), totals={"_P": "tp", "_N": "fp"})


def curve(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """One point per distinct threshold (score desc): tp, fp, tpr, fpr, precision, recall."""
    g = list(groups or [])
    return cumulated_scores(df, label, score, g).select(
        *g, F.col(score).alias("threshold"), "threshold_rank", "pos", "neg",
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        F.try_divide("tp", "_P").alias("tpr"), F.try_divide("fp", "_N").alias("fpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", "_P").alias("recall"), "_P",
    )


def average_precision(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Step-wise AP = sum over thresholds of (recall step) x precision."""
    g = list(groups or [])
    c = curve(df, label, score, g)
    ap = F.sum(F.try_divide(F.col("pos"), F.col("_P")) * F.col("precision"))
    return c.groupBy(*g).agg(F.when(F.first("_P") > 0, ap).alias("pr_auc"))


def brier(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """W12"""
    g = list(groups or [])
    return df.groupBy(*g).agg(F.avg(F.pow(F.col(score) - _y(label), 2)).alias("brier"))


def _cut(n: Column, frac: float, rounding: str) -> Column:
    """k = max(1, floor(n * frac)) (service) or max(1, ceil(n * frac)) (notebooks)."""
    x = n * F.lit(float(frac))
    return F.greatest(F.lit(1), (F.floor(x) if rounding == "floor" else F.ceil(x)).cast("long"))


def _hits(df: DataFrame, cum: DataFrame, label: str, score: str, key: str, fracs: list[float], rounding: str, groups: list[str]) -> DataFrame:
    """Positives among the top k of each share: (groups, _share, _hit).

    Scores that lie wholly above the cut count from the cumulated scores; rows are ranked (by id)
    only inside the one score that holds the cut.
    """
    n = F.col("_P") + F.col("_N")
    share = F.explode(F.array(*[F.struct(F.lit(i).alias("_share"), _cut(n, f, rounding).alias("_k")) for i, f in enumerate(fracs)]))
    reach = F.col("tp") + F.col("fp")
    rows = cum.select(*groups, F.col(score).alias("_s"), "pos", "neg", (reach - F.col("pos") - F.col("neg")).alias("_above"), reach.alias("_reach"), share.alias("c"))
    rows = rows.select(*groups, "_s", "pos", "_above", "_reach", "c._share", "c._k").where("_above < _k")
    above = rows.where("_reach <= _k").groupBy(*groups, "_share").agg(F.sum("pos").alias("_hit"))
    split = rows.where("_reach > _k").select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_s", "_share", (F.col("_k") - F.col("_above")).alias("_room"))
    on = F.col(score) == F.col("_s")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = df.join(split, on).select(*groups, "_share", F.col(key).alias("_id"), _y(label).alias("_y"), "_room")
    inside = global_order(inside, [F.col("_id").asc()], "_nth", partition_by=[*groups, "_share"])
    inside = inside.where("_nth <= _room").groupBy(*groups, "_share").agg(F.sum("_y").alias("_hit"))
    return above.unionByName(inside).groupBy(*groups, "_share").agg(F.sum("_hit").alias("_hit"))


def _topk_columns(i: int, frac: float, rounding: str) -> list[Column]:
    """precision, recall and lift of a share from _hit<i> and the totals _P and _rows."""
    pct, hit = int(round(frac * 100)), F.coalesce(F.col(f"_hit{i}"), F.lit(0))
    precision = hit / _cut(F.col("_rows"), frac, rounding)
    least = F.lit(1e-9 if rounding == "floor" else 1e-12)
    return [precision.alias(f"precision_at_{pct}"), (hit / F.greatest(F.col("_P"), F.lit(1))).alias(f"recall_at_{pct}"),
            (precision / F.greatest(F.col("_P") / F.col("_rows"), least)).alias(f"lift_at_{pct}")]


def score_metrics(df: DataFrame, label: str, score: str, key: str, fracs: list[float], rounding: str = "floor",
                  groups: list[str] | None = None, threshold: float = 0.5, written: bool = False) -> DataFrame:
    """Everything that distinct scores tell, in one pass over them per group: roc_auc, pr_auc, brier,
    tp, fp, fn at the threshold, and precision / recall / lift at each share. ``written``: df is cheap to read again."""
    g = list(groups or [])
    rows = df.select(*g, key, label, score).where(F.col(score).isNotNull())
    rows = rows if written else rows.checkpoint(eager=True)  # read by the counts and by the cuts
    cum = cumulated_scores(rows, label, score, g).checkpoint(eager=True)
    s, pos, neg = F.col(score), F.col("pos"), F.col("neg")
    out = cum.groupBy(*g).agg(
        F.max("_P").alias("_P"), F.max("_N").alias("_N"), F.sum(pos * (F.col("_N") - F.col("fp") + 0.5 * neg)).alias("_u"),
        F.sum(F.try_divide(pos, F.col("_P")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("_ap"),
        F.sum(pos * F.pow(s - 1, 2) + neg * F.pow(s, 2)).alias("_sq"),
        F.coalesce(F.sum(F.when(s >= threshold, pos)), F.lit(0)).alias("_tp"), F.coalesce(F.sum(F.when(s >= threshold, neg)), F.lit(0)).alias("_fp"))
    hits = _hits(rows, cum, label, score, key, fracs, rounding, g)
    wide = hits.groupBy(*[F.col(x).alias(f"_h_{x}") for x in g]).agg(
        *[F.max(F.when(F.col("_share") == i, F.col("_hit"))).alias(f"_hit{i}") for i in range(len(fracs))])
    on = F.lit(True)
    for x in g:
        on = on & F.col(x).eqNullSafe(F.col(f"_h_{x}"))
    out = out.join(wide, on, "left") if g else out.crossJoin(wide)  # one row each without groups
    out = out.withColumns({"_rows": F.col("_P") + F.col("_N"), "tp": F.col("_tp"), "fp": F.col("_fp"), "fn": F.col("_P") - F.col("_tp")})
    both = (F.col("_P") > 0) & (F.col("_N") > 0)
    metrics = [F.when(both, F.try_divide(F.col("_u"), F.col("_P") * F.col("_N"))).alias("roc_auc"),
               F.when(F.col("_P") > 0, F.col("_ap")).alias("pr_auc"), F.try_divide(F.col("_sq"), F.col("_rows")).alias("brier")]
    return with_prf(out.select(*g, *metrics, "tp", "fp", "fn", *[c for i, f in enumerate(fracs) for c in _topk_columns(i, f, rounding)]))


def topk(df: DataFrame, label: str, score: str, key: str, frac: float = 0.2, rounding: str = "floor",
         groups: list[str] | None = None) -> DataFrame:
    """Precision / recall / lift in the top ``frac`` by score (ties: smaller id first), from cells of scores: no order of all rows."""
    g = list(groups or [])
    rows = df.where(F.col(score).isNotNull()).select(*g, key, score, _y(label).alias("_y")).checkpoint(eager=True)  # narrow, read by each pass
    sums = top_sums(rows, g, score, key, {"_hits": F.col("_y")}, [(frac, _cut(F.col("_size"), frac, rounding)), (1.0, F.col("_size"))])
    wide = sums.groupBy(*g).agg(F.max("_size").alias("_rows"), F.max(F.when(F.col("_t") == 0, F.col("_hits"))).alias("_hit0"),
                                F.max(F.when(F.col("_t") == 1, F.col("_hits"))).alias("_P")).where("_rows is not null")
    return wide.select(*g, *_topk_columns(0, frac, rounding))


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5,
              groups: list[str] | None = None) -> DataFrame:
    """Confusion counts and precision / recall / F1 / F2 at a threshold (0 when undefined)."""
    g = list(groups or [])
    pred = (F.col(score) >= F.lit(float(threshold))).cast("int")
    y = _y(label)
    out = df.groupBy(*g).agg(
        F.count_if((y == 1) & (pred == 1)).alias("tp"), F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 1) & (pred == 0)).alias("fn"))
    return with_prf(out)


def with_prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    f2 = F.when(p + r > 0, 5 * p * r / (4 * p + r)).otherwise(F.lit(0.0))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1, "f2": f2})


GRID_PROBS = [float(x) for x in np.linspace(0.05, 0.95, 61)]


def threshold_grid(df: DataFrame, score: str, key: str) -> DataFrame:
    """61 exact quantiles of the score, 5%..95%."""
    return exact_quantiles(df, score, GRID_PROBS, key).select(F.col("_i").alias("grid_index"), F.col("q").alias("t"))


def f2_threshold(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """M18 + J8: the grid threshold with the best F2 (first maximum in grid order wins).

    Works on distinct scores with their counts: the rows are read once. Each score gets the
    number of grid thresholds it reaches (``score >= t``); the counts of a threshold are
    sums over at most 62 buckets.
    """
    scores = score_table(df.select(key, score, label), label, score).checkpoint(eager=True)
    grid = exact_quantiles(scores, score, GRID_PROBS, weight=F.col("pos") + F.col("neg"), written=True)
    arr = grid.agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("grid_index"), F.col("q").alias("t")))).alias("_g"))  # 61 entries
    reach = F.size(F.filter(F.col("_g"), lambda e: F.col(score) >= e["t"]))
    buckets = scores.crossJoin(F.broadcast(arr)).groupBy("_g", reach.alias("_reach")).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    table = buckets.groupBy("_g").agg(F.sum("_pos").alias("_P"), F.collect_list(F.struct("_reach", "_pos", "_neg")).alias("_b"))  # one row of 62

    def reached(e: Column, what: str) -> Column:
        """Rows whose score reaches a threshold (the grid ascends)."""
        return F.aggregate(F.filter("_b", lambda b: b["_reach"] > e["grid_index"]), F.lit(0).cast("long"), lambda acc, b: acc + b[what])

    rows = table.select("_P", F.explode(F.transform("_g", lambda e: F.struct(
        e["grid_index"].alias("grid_index"), e["t"].alias("t"), reached(e, "_pos").alias("tp"), reached(e, "_neg").alias("fp")))).alias("e"))
    rows = with_prf(rows.select("_P", "e.*").withColumn("fn", F.col("_P") - F.col("tp")))
    best = rows.agg(F.min_by(F.struct("grid_index", "t", "f2"), F.struct((-F.col("f2")).alias("a"), F.col("grid_index").alias("b"))).alias("b"))
    return best.select(F.col("b.t").alias("threshold"), F.col("b.f2").alias("f2"), F.col("b.grid_index").alias("grid_index"))


def evaluation_row(df: DataFrame, label: str, score: str, key: str, threshold: float = 0.5,
                   rounding: str = "ceil") -> DataFrame:
    """One row of 14 metrics from one table of distinct scores."""
    m = score_metrics(df, label, score, key, [0.10, 0.20], rounding, threshold=threshold)
    at = [f"{name}_at_{pct}" for pct in (10, 20) for name in ("precision", "recall", "lift")]
    return m.select("roc_auc", "pr_auc", "brier", "precision", "recall", "f1", *at).withColumn("threshold", F.lit(float(threshold)))


def metric_deltas(df: DataFrame, label: str, model: str, baseline: str, key: str, groups: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of a score and of a baseline score, and their difference, in long form."""
    def of(score: str, name: str) -> DataFrame:
        pairs = ", ".join(f"'{m}', {m}" for m in metrics)
        rows = score_metrics(df, label, score, key, [0.20], "ceil", groups)
        return rows.selectExpr(*[f"`{g}`" for g in groups], f"stack({len(metrics)}, {pairs}) as (metric, {name})")

    out = of(model, "model").join(of(baseline, "baseline"), [*groups, "metric"])
    return out.withColumn("delta", F.col("model") - F.col("baseline"))


def quality_index(metrics: DataFrame) -> DataFrame:
    """N16"""
    q = (0.35 * F.col("roc_auc") + 0.25 * F.col("pr_auc") + 0.20 * F.least(F.col("lift_at_20") / 3, F.lit(1.0))
         + 0.10 * F.col("recall_at_20") + 0.10 * (1 - F.col("brier")))
    return metrics.withColumn("quality_index", q)


def selection_score(roc: Column, ap: Column, lift20: Column) -> Column:
    """N15"""
    return 0.50 * roc + 0.30 * ap + 0.20 * lift20 / 3.0


def segment_quality(df: DataFrame, segment_cols: list[str] | str, label: str, score: str, key: str, loss: str,
                    min_rows: int = 50) -> DataFrame:
    """Per-segment quality for one or many segment columns; segments under ``min_rows``
    rows are dropped. No driver loop: the segment columns are unpivoted to
    (segment, value) and every metric runs once, grouped by that pair."""
    cols = [segment_cols] if isinstance(segment_cols, str) else list(segment_cols)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    rows = df.select(key, label, score, loss, *cols).checkpoint(eager=True)  # each row once; unpivoted where it is read
    long = rows.selectExpr(f"`{key}`", f"`{label}`", f"`{score}`", f"`{loss}`", f"stack({len(cols)}, {pairs}) as (segment, value)")
    g = ["segment", "value"]
    base = long.groupBy(*g).agg(F.count(F.lit(1)).alias("rows"), F.avg(_y(label)).alias("cancel_rate"),
                                F.sum(loss).alias("expected_loss_sum"))
    metrics = score_metrics(long, label, score, key, [0.20], "ceil", g, written=True).select(
        F.col("segment").alias("_s"), F.col("value").alias("_v"), "roc_auc", "pr_auc", "precision_at_20", "recall_at_20", "lift_at_20")
    out = base.join(metrics, F.col("segment").eqNullSafe(F.col("_s")) & F.col("value").eqNullSafe(F.col("_v")))
    return out.where(F.col("rows") >= min_rows).select(
        "segment", "value", "rows", "cancel_rate", "roc_auc", "pr_auc", "precision_at_20", "recall_at_20",
        "lift_at_20", "expected_loss_sum")
