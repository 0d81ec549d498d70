"""Learned operators on Spark ML.

Pipeline = train-only target / frequency encoder (``encode.py``) ->
median imputation of numeric features -> rare categories pooled -> one-hot
-> vector assembly -> scaling without centring -> classifier. Probabilities
are calibrated on the validation split (Platt or isotonic). Candidate settings
are a short driver-side list; each candidate is one distributed fit, a few run side by side.

Class balance ("balanced" weights) enters as ``weightCol``. Spark's GBT cannot
reproduce the original boosting library (no leaf-count control), so metrics are
our own and are never claimed to equal the original numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, LogisticRegressionModel, ProbabilisticClassificationModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import Imputer, ImputerModel, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET_ENCODING_OUTPUT_FEATURES as ENCODED_FEATURES
from . import encode as ENC
from . import evaluate as EV
from . import files

LABEL = "is_canceled"
KEY = "booking_id"
#: Marks the rows on which boosting watches its error, to stop where it no longer falls.
VALID = "_valid"
#: Candidates fitted at a time: their jobs share the executors, so that the short ones of one fill the gaps of another.
FITS_AT_ONCE = 4
#: Rows that the fits running side by side hold together, each its own copy: with more rows fewer run at a time, one at least.
ROWS_AT_ONCE = 16_000_000
#: The same for rows with a vector of their words.
TEXT_ROWS_AT_ONCE = 2_000_000
#: Rows from which a partition's node statistics in a forest's fit are small beside its rows.
ROWS_A_TASK = 200_000
#: Node ids (one a row and tree) that a forest's fit keeps beside its rows; three sets of them live at a time.
NODE_IDS = 250_000_000
#: Distinct values of a column in a hundredth of the rows up to which the values of all rows are counted for its median.
FEW_VALUES = 500
#: Rows below which a partition of a fit is not worth a task of its own.
LEAST_ROWS_A_TASK = 10_000


def class_weight_column(train: DataFrame, label: str = LABEL) -> DataFrame:
    """A33 as a ``weightCol``: n / (2 * n_class), joined by label (two-row table)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    tot = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return train.join(F.broadcast(w), label)


@dataclass
class CategoryTables:
    """Train-only category state: the text mode of each column (one row) and the kept categories."""
    modes: DataFrame   # one row: _mode_<column>
    kept: DataFrame    # column, value, n  (categories seen n >= min_frequency times in train)


def fit_category_tables(train: DataFrame, columns: list[str], min_frequency: int = 10) -> CategoryTables:
    """M6 + M8 fit: ``mode`` per column and the categories frequent enough to get their own slot."""
    modes = train.agg(*[F.mode(c).alias(f"_mode_{c}") for c in columns])
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = train.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)")
    kept = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_frequency)
    return CategoryTables(modes=modes, kept=kept)


def written(tables: CategoryTables) -> CategoryTables:
    """The same tables without the plan over the train rows above them, for those that read them more than once."""
    return CategoryTables(modes=tables.modes.checkpoint(eager=True), kept=tables.kept.checkpoint(eager=True))


def with_modes(df: DataFrame, tables: CategoryTables, columns: list[str]) -> DataFrame:
    """M6: NULL -> train mode."""
    j = df.crossJoin(F.broadcast(tables.modes))
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_mode_{c}")) for c in columns}).drop(*[f"_mode_{c}" for c in columns])


def category_lookup(tables: CategoryTables) -> DataFrame:
    """The kept categories as a lookup table, their columns named apart from those of the encoder."""
    return tables.kept.select(F.concat(F.lit("cat_"), "column").alias("column"), F.col("value").alias("key"), "n")


def pooled(columns: list[str], found: str = "_found") -> dict[str, Column]:
    """M8: categories outside the kept set -> 'infrequent'."""
    return {c: F.when(F.col(f"`{found}`.`cat_{c}`").isNotNull(), F.col(c)).otherwise(F.lit("infrequent")) for c in columns}


def apply_category_tables(df: DataFrame, tables: CategoryTables, columns: list[str]) -> DataFrame:
    """M6 + M8, all columns in one lookup."""
    out = with_modes(df, tables, columns)
    out = ENC.lookup_columns(out, {f"cat_{c}": F.col(c) for c in columns}, category_lookup(tables), ["n"])
    return out.withColumns(pooled(columns)).drop("_found")


def classifier(kind: str, params: dict | None = None, seed: int = 42, rows: int = 1):
    """M10-M12. The inverse strength ``C`` of the logistic loss summed over ``rows`` weighted rows is
    ``1 / (C * rows)`` for Spark's mean loss."""
    params = dict(params or {})
    if kind == "logreg":
        return LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol="weight",
                                  standardization=False, maxIter=params.get("maxIter", 200),
                                  regParam=params.get("regParam", 1.0 / (params.get("C", 1.0) * max(1, rows))))
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol="features", labelCol=LABEL, weightCol="weight", seed=seed,
                                      numTrees=params.get("numTrees", 160), maxDepth=params.get("maxDepth", 16),
                                      minInstancesPerNode=params.get("minInstancesPerNode", 50), maxMemoryInMB=512,
                                      cacheNodeIds=True)  # else each level walks every tree from its root for every row
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol=LABEL, weightCol="weight", seed=seed,
                             maxIter=params.get("maxIter", 60), stepSize=params.get("stepSize", 0.1),
                             maxDepth=params.get("maxDepth", 6),
                             minInstancesPerNode=params.get("minInstancesPerNode", 70),
                             subsamplingRate=params.get("subsamplingRate", 0.9), validationIndicatorCol=VALID,
                             validationTol=params.get("validationTol", 0.002), maxMemoryInMB=512)
    raise ValueError(kind)


def fit_classifier(kind: str, params: dict | None, seed: int, rows: int, source: DataFrame) -> list:
    """The fitted models whose votes make up the classifier: one, but a forest of more than NODE_IDS rows times trees is
    fitted in parts one after another, so that its node ids stay bounded."""
    params = dict(params or {})
    if kind != "random_forest":
        return [classifier(kind, params, seed, rows).fit(source)]
    trees = params.get("numTrees", 160)
    parts = max(1, min(trees, -(-rows * trees // NODE_IDS)))
    fitted = []
    for i in range(parts):
        part = classifier(kind, {**params, "numTrees": trees * (i + 1) // parts - trees * i // parts}, seed + i, rows)
        if i:
            part.setPredictionCol(f"prediction_{i}").setRawPredictionCol(f"rawPrediction_{i}").setProbabilityCol(f"probability_{i}")
        fitted.append(part.fit(source))
    return fitted


def with_votes(models: list, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability of the positive class as ``raw_score``: the mean vote of all trees of a forest in parts."""
    for m in models:
        rows = m.transform(rows)
    of = [vector_to_array(m.getProbabilityCol()).getItem(1) for m in models]
    if len(of) == 1:
        return rows.withColumn("raw_score", of[0])
    votes = [m.getNumTrees for m in models]
    return rows.withColumn("raw_score", sum(p * float(n) for p, n in zip(of, votes)) / float(sum(votes)))


def feature_stages(numeric: list[str], categorical: list[str]) -> list:
    """M5, M7, M8, M9: imputer -> scaled numeric block; indexer (unknown kept, its slot dropped = all
    zeros) -> one-hot; both assembled. Only the numeric block is scaled."""
    imp_out = [f"{c}__imp" for c in numeric]
    idx_out = [f"{c}__idx" for c in categorical]
    ohe_out = [f"{c}__ohe" for c in categorical]
    return [
        Imputer(strategy="median", inputCols=numeric, outputCols=imp_out, relativeError=0.0001),
        StringIndexer(inputCols=categorical, outputCols=idx_out, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx_out, outputCols=ohe_out, handleInvalid="keep", dropLast=True),
        VectorAssembler(inputCols=imp_out, outputCol="numeric_block", handleInvalid="keep"),
        StandardScaler(inputCol="numeric_block", outputCol="numeric_scaled", withMean=False, withStd=True),
        VectorAssembler(inputCols=["numeric_scaled"] + ohe_out, outputCol="features", handleInvalid="keep"),
    ]


def fit_imputer(imputer: Imputer, train: DataFrame) -> ImputerModel:
    """M5 fit. A sketch holds and sorts every value it gets, so it is left to columns of many values; the medians of columns of
    few (by a sample of a hundredth, which tells what must be held and not the median) come from exact counts of their values in all rows.
    The imputer is fitted on the one row of these medians, each its own median."""
    columns = imputer.getInputCols()
    sizes = train.sample(0.01, seed=1).agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()
    few = [c for c in columns if sizes[c] <= FEW_VALUES]
    many = [c for c in columns if c not in few]
    medians = dict.fromkeys(columns)
    if few:
        known = "nanvl(CAST(`{}` AS DOUBLE), CAST(NULL AS DOUBLE))"
        medians |= train.agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {known.format(c)})").alias(c) for c in few]).first().asDict()
    if many:
        medians |= {c: next(iter(q), None) for c, q in zip(many, train.stat.approxQuantile(many, [0.5], imputer.getRelativeError()))}
    row = train.sparkSession.createDataFrame([tuple(medians[c] for c in columns)], ", ".join(f"`{c}` double" for c in columns))
    return imputer.fit(row)


@dataclass
class TrainedModel:
    pipeline: PipelineModel
    encoder: ENC.EncoderModel
    categories: CategoryTables
    calibrator: object | None = None
    name: str = ""
    metrics: dict = field(default_factory=dict)
    categorical: list[str] = field(default_factory=lambda: list(CATEGORICAL_FEATURES))


def _encode(df: DataFrame, encoder: ENC.EncoderModel, categories: CategoryTables, categorical: list[str]) -> DataFrame:
    """Encoded columns and pooled categories, from one lookup over both tables."""
    base = df.drop(*[c for c in df.columns if c.endswith("_target_mean_smooth") or c.endswith("_freq_log")])
    own = base.withColumns({f"_own_{c}": k for c, k in ENC.encoder_keys(base, encoder.columns).items()})  # as it came, before a mode fills it
    out = with_modes(own, categories, categorical).crossJoin(F.broadcast(encoder.prior))
    keys = {**{c: F.col(f"_own_{c}") for c in encoder.columns}, **{f"cat_{c}": F.col(c) for c in categorical}}
    table = encoder.stats.select("column", "key", "n", "smooth_mean").unionByName(
        category_lookup(categories).withColumn("smooth_mean", F.lit(None).cast("double")))
    out = ENC.lookup_columns(out, keys, table, ["n", "smooth_mean"])
    encoded = ENC.encoded_columns(encoder.columns, [c for c in encoder.columns if c in ENC.FREQUENCY_COLUMNS])
    return out.withColumns({**encoded, **pooled(categorical)}).drop("prior", "_found", *[f"_own_{c}" for c in encoder.columns])


def raw_probability(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Probability of the positive class as a double column ``raw_score``."""
    encoded = _encode(in_small_methods(df, KEY), model.encoder, model.categories, model.categorical)
    if isinstance(model.pipeline.stages[-1], RandomForestClassificationModel):  # votes of many deep trees cost more than moving the rows
        spark = df.sparkSession
        encoded = encoded.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return pipeline_score(model, encoded)


def pipeline_score(model: TrainedModel, encoded: DataFrame) -> DataFrame:
    """``raw_score`` of rows that are encoded already."""
    stages = model.pipeline.stages
    models = [s for s in stages if isinstance(s, ProbabilisticClassificationModel)]
    return with_votes(models, PipelineModel(stages=stages[:len(stages) - len(models)]).transform(encoded))


def fit_platt(valid_scored: DataFrame, score: str = "raw_score", label: str = LABEL):
    """Logistic calibration on one feature; None when the validation split has one class."""
    classes = valid_scored.agg(F.count_distinct(label).alias("k")).first()["k"]
    if classes < 2:
        return None
    n = valid_scored.count()
    data = VectorAssembler(inputCols=[score], outputCol="_cal_x").transform(valid_scored)
    lr = LogisticRegression(featuresCol="_cal_x", labelCol=label, regParam=1.0 / max(n, 1),
                            standardization=False, maxIter=1000, tol=1e-10, predictionCol="_cal_pred",
                            probabilityCol="_cal_prob", rawPredictionCol="_cal_raw")
    return lr.fit(data)


def fit_isotonic(valid_scored: DataFrame, score: str = "raw_score", label: str = LABEL):
    """M16"""
    data = VectorAssembler(inputCols=[score], outputCol="_cal_x").transform(valid_scored)
    return IsotonicRegression(featuresCol="_cal_x", labelCol=label, predictionCol="_cal_iso").fit(data)


def apply_calibration(df: DataFrame, calibrator, score: str = "raw_score", out: str = "calibrated") -> DataFrame:
    """Calibrated probability clipped to [0, 1]; the raw score when no calibrator exists."""
    raw = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    if calibrator is None:
        return df.withColumn(out, raw)
    data = VectorAssembler(inputCols=[score], outputCol="_cal_x").transform(df.withColumn(score, raw))
    res = calibrator.transform(data)
    if isinstance(calibrator, LogisticRegressionModel):
        val = vector_to_array("_cal_prob").getItem(1)
        drop = ["_cal_x", "_cal_prob", "_cal_raw", "_cal_pred"]
    elif isinstance(calibrator, IsotonicRegressionModel):
        val = F.col("_cal_iso")
        drop = ["_cal_x", "_cal_iso"]
    else:
        raise TypeError(type(calibrator))
    return res.withColumn(out, F.least(F.greatest(val, F.lit(0.0)), F.lit(1.0))).drop(*drop)


def evaluate_scores(df: DataFrame, score: str, label: str = LABEL) -> dict:
    """M19 reduced to the metrics used for selection.

    The (id, label, score) triple is written once to the checkpoint folder, so the
    model is applied once and every metric reads the narrow table.
    """
    narrow = df.select(KEY, label, score).checkpoint(eager=True)
    row = EV.evaluation_row(narrow, label, score, KEY, rounding="floor").first().asDict()
    return {k: (float(v) if v is not None else None) for k, v in row.items()}


def _split_sizes(df: DataFrame) -> dict[str, int]:
    """Rows of the three splits that training knows; other labels are not counted."""
    return df.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")]).first().asDict()


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """At most one partition for each core, or for each ROWS_A_TASK rows where those are more.

    A forest's level sends the statistics of every open node from every partition, so with many small partitions they outweigh the rows."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return df.repartition(parts) if df.rdd.getNumPartitions() > parts else df  # dealt out evenly: the parts of train and valid lie side by side


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A written table whose small shuffles were joined to fewer partitions than cores, dealt out to all cores: fits are long for their bytes."""
    parts = min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS_A_TASK)
    return df.repartition(parts).checkpoint(eager=True) if df.rdd.getNumPartitions() < parts else df


def side_by_side(fit: Callable, settings: list, rows: int, at_once: int, spark) -> list:
    """``fit`` of each setting, a few at a time: the more rows each of them holds, the fewer, so that they hold about ``at_once`` together."""
    with ThreadPoolExecutor(max_workers=max(1, min(FITS_AT_ONCE, len(settings), at_once // max(1, rows)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), settings))


def in_small_methods(df: DataFrame, column: str) -> DataFrame:
    """The same rows; the projection that ends here stays out of whole-stage code, which has no form for functions over arrays.

    It would hold all derived columns in one method beyond the 8000 bytes that the JVM compiles, and run interpreted; as it is they get a method for every few."""
    return df.withColumn(column, F.element_at(F.transform(F.array(column), lambda x: x), 1))


DEFAULT_CANDIDATES = [
    ("GBT conservative", "gbt", {"maxIter": 40, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 70}),
    ("GBT stronger", "gbt", {"maxIter": 60, "stepSize": 0.08, "maxDepth": 6, "minInstancesPerNode": 45}),
]


def train_model(prepared: DataFrame, candidates=None, calibration: str = "platt", seed: int = 42,
                max_rows: int | None = None, numeric: list[str] | None = None, categorical: list[str] | None = None,
                encoded: list[str] | None = None) -> TrainedModel:
    """M17 + M22: fit the candidates on train, select by 0.5 ROC + 0.3 AP + 0.2 Lift@20/3 on valid,
    calibrate on valid, report test metrics. ``prepared`` needs ``is_canceled``; the split
    is the existing column, else creation-date cutoffs, else chronological (D8, D10, W7);
    an empty test or valid split falls back to seeded hash buckets (U4). ``max_rows``, if given,
    bounds about the train rows that the classifier fit reads (those of the least seeded hashes);
    splits, encoder, categories, imputing, scaling, choice, calibration and metrics use all rows.

    The feature vectors of train and valid are written once and read by all candidates, which are fitted side by side; boosting
    stops where its error on valid no longer falls (M12). ``numeric``, ``categorical`` and ``encoded``: the input columns, those of the
    engine if not given; the columns that encoding adds come on top of ``numeric``."""
    from .filters import id_hash
    from .rank import assign_split, fill_empty_splits
    candidates = candidates or DEFAULT_CANDIDATES
    categorical = list(CATEGORICAL_FEATURES if categorical is None else categorical)
    encoded = list(ENC.TARGET_ENCODED_COLUMNS if encoded is None else encoded)
    made = list(ENC.encoded_columns(encoded, [c for c in encoded if c in ENC.FREQUENCY_COLUMNS]))
    numeric = [c for c in (NUMERIC_FEATURES if numeric is None else numeric) if c not in ENCODED_FEATURES] + made
    prepared, strategy = assign_split(prepared)
    # read by the split sizes, the statistics and the encoding: the needed columns are materialised once in the shared checkpoint folder
    wanted = dict.fromkeys([KEY, LABEL, "split", *numeric, *categorical, *encoded])
    prepared = prepared.select(*[c for c in wanted if c in prepared.columns and c not in made])
    prepared = in_small_methods(prepared, LABEL).checkpoint(eager=True)
    sizes = _split_sizes(prepared)
    prepared, moved = fill_empty_splits(prepared, sizes, seed)
    if moved:
        strategy, sizes = "random_fallback", _split_sizes(prepared)
    prepared = spread(prepared, sum(sizes.values()))
    train = prepared.where(F.col("split") == "train")
    encoder = ENC.fit_target_encoder(train, LABEL, encoded)
    categories = written(fit_category_tables(train, categorical))
    enc = _encode(prepared.where(F.col("split").isin("train", "valid", "test")), encoder, categories, categorical)
    enc = enc.select(KEY, LABEL, "split", *numeric, *categorical).checkpoint(eager=True)
    split = lambda name: enc.where(F.col("split") == name).drop("split")
    stages = feature_stages(numeric, categorical)
    features = Pipeline(stages=[fit_imputer(stages[0], split("train")), *stages[1:]]).fit(split("train"))
    fit_rows, rows = split("train"), sizes.get("train", 0)
    if max_rows and rows > max_rows:
        fit_rows = fit_rows.where(id_hash(F.col(KEY), seed + 2) < int(max_rows / rows * (1 << 60)))
        rows = fit_rows.count()
    table = features.transform(class_weight_column(fit_rows).withColumn(VALID, F.lit(False)).unionByName(
        split("valid").withColumns({"weight": F.lit(1.0), VALID: F.lit(True)}))).select(KEY, LABEL, "weight", VALID, "features").checkpoint(eager=True)
    fit_table, valid_table = table.where(~F.col(VALID)), table.where(F.col(VALID))

    def fit(candidate: tuple) -> tuple:
        name, kind, params = candidate
        source = table if kind == "gbt" else by_rows(fit_table, rows) if kind == "random_forest" else fit_table
        fitted = fit_classifier(kind, params, seed, rows, source)
        v = with_votes(fitted, valid_table).select(KEY, LABEL, "raw_score").checkpoint(eager=True)
        m = evaluate_scores(v, "raw_score")
        return name, fitted, v, m, EV.selection_score(m["roc_auc"], m["pr_auc"], m["lift_at_20"])

    results = side_by_side(fit, candidates, rows, ROWS_AT_ONCE, prepared.sparkSession)
    report = [{"name": name, "valid_roc_auc": m["roc_auc"], "valid_pr_auc": m["pr_auc"], "valid_lift@20": m["lift_at_20"], "selection_score": sel,
               "rounds": sum(len(m.trees) for m in fitted) if hasattr(fitted[0], "trees") else None} for name, fitted, _, m, sel in results]
    name, fitted, valid_scored, *_ = max(results, key=lambda r: r[-1])  # the first of equal ones
    model = TrainedModel(pipeline=PipelineModel(stages=[*features.stages, *fitted]), encoder=encoder, categories=categories, name=name, categorical=categorical)
    model.calibrator = fit_platt(valid_scored) if calibration == "platt" else fit_isotonic(valid_scored)
    scored_test = pipeline_score(model, split("test")).select(KEY, LABEL, "raw_score").checkpoint(eager=True)
    t = apply_calibration(scored_test, model.calibrator)
    cal = evaluate_scores(t, "calibrated")
    raw = evaluate_scores(scored_test, "raw_score")
    model.metrics = {
        "model": model.name + (" + Platt calibration" if calibration == "platt" else " + isotonic calibration"),
        "split_strategy": strategy, "rows_train": sizes.get("train", 0), "rows_fit": rows, "rows_calibration": sizes.get("valid", 0),
        "rows_test": sizes.get("test", 0),
        "roc_auc": cal["roc_auc"], "pr_auc": cal["pr_auc"], "brier": cal["brier"],
        "roc_auc_raw": raw["roc_auc"], "pr_auc_raw": raw["pr_auc"], "brier_raw": raw["brier"],
        "precision@20": raw["precision_at_20"], "recall@20": raw["recall_at_20"], "lift@20": raw["lift_at_20"],
        "candidate_metrics": report,
    }
    return model


def predict(model: TrainedModel, prepared: DataFrame) -> DataFrame:
    """Prepared bookings -> raw score -> calibrated probability -> business fields."""
    from .business import enrich_predictions
    scored = apply_calibration(raw_probability(model, prepared), model.calibrator)
    return enrich_predictions(scored, "raw_score", "calibrated")


def save_model(model: TrainedModel, path: str) -> None:
    """Pipeline, encoder statistics, calibrator and metrics, each save in a folder of its own.

    The pointer ``CURRENT`` is renamed to the new folder last, so a save that dies leaves the model before it in
    place. The folder before the one that was current is removed: a reader that follows the old pointer still finds its own.
    """
    spark = model.encoder.stats.sparkSession
    folder = f"{path}/versions/{uuid.uuid4().hex}"
    model.pipeline.write().save(f"{folder}/pipeline")
    model.encoder.stats.write.parquet(f"{folder}/encoder_stats")
    model.encoder.prior.write.parquet(f"{folder}/encoder_prior")
    model.categories.modes.write.parquet(f"{folder}/category_modes")
    model.categories.kept.write.parquet(f"{folder}/category_kept")
    if model.calibrator is not None:
        model.calibrator.write().save(f"{folder}/calibrator")
    meta = {"name": model.name, "metrics": model.metrics, "calibrator": type(model.calibrator).__name__, "columns": model.encoder.columns,
            "smoothing": model.encoder.smoothing, "categorical": model.categorical}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.text(f"{folder}/meta")
    before = json.loads(files.read_text(spark, f"{path}/CURRENT") or "{}")
    files.point(spark, f"{path}/CURRENT", json.dumps({"folder": folder, "previous": before.get("folder")}))
    if before.get("previous"):
        files.remove(spark, before["previous"])


def current_model(spark, path: str) -> str | None:
    """The folder of the current model: where the pointer leads, else ``path`` itself where a model was saved without one."""
    text = files.read_text(spark, f"{path}/CURRENT")
    if text:
        return json.loads(text)["folder"]
    return path if files.exists(spark, f"{path}/meta") else None


def model_exists(spark, path: str) -> bool:
    """Asks the file system of the path (any address that Spark can read)."""
    return current_model(spark, path) is not None


def load_model(spark, path: str, require_trained: bool = False) -> TrainedModel | None:
    """The saved model; None (the caller falls back to the rule score) only where there is none.

    A model that is there but cannot be read is an error.
    """
    folder = current_model(spark, path)
    if folder is None:
        if require_trained:
            raise FileNotFoundError(f"trained model not found at {path}")
        return None
    pipeline = PipelineModel.load(f"{folder}/pipeline")
    meta = json.loads(spark.read.text(f"{folder}/meta").first()["value"])
    cal = None
    if meta.get("calibrator") == "LogisticRegressionModel":
        cal = LogisticRegressionModel.load(f"{folder}/calibrator")
    elif meta.get("calibrator") == "IsotonicRegressionModel":
        cal = IsotonicRegressionModel.load(f"{folder}/calibrator")
    enc = ENC.EncoderModel(stats=spark.read.parquet(f"{folder}/encoder_stats"), prior=spark.read.parquet(f"{folder}/encoder_prior"),
                           columns=meta.get("columns", list(ENC.TARGET_ENCODED_COLUMNS)), smoothing=meta.get("smoothing", ENC.ENCODER_SMOOTHING))
    kept = spark.read.parquet(f"{folder}/category_kept")
    cats = CategoryTables(modes=spark.read.parquet(f"{folder}/category_modes"), kept=kept if "n" in kept.columns else kept.withColumn("n", F.lit(1).cast("long")))
    return TrainedModel(pipeline=pipeline, encoder=enc, categories=cats, calibrator=cal, name=meta.get("name", ""), metrics=meta.get("metrics", {}),
                        categorical=meta.get("categorical", list(CATEGORICAL_FEATURES)))


TEXT_ALPHAS = (1e-5, 3e-5, 1e-4, 3e-4, 1e-3)


def text_model(rows: DataFrame, reg_params=TEXT_ALPHAS, text_col: str = "booking_text", numeric: list[str] | None = None,
               categorical: list[str] | None = None, min_df: float = 5.0, vocab_size: int = 12000,
               min_frequency: int = 30) -> tuple[object, list[dict]]:
    """Numeric features (median, scaled), categories (mode, one-hot, rare ones pooled) and word 1- and
    2-gram TF-IDF in one vector; logistic loss with balanced classes, regularisation chosen on the
    validation split by ROC-AUC. ``vocab_size`` is the published bound of the vocabulary; the report
    says how many terms of the wanted document frequency it leaves out. ``rows`` needs split, label, id."""
    from pyspark.ml.feature import NGram, RegexTokenizer
    numeric = list(numeric if numeric is not None else [c for c in NUMERIC_FEATURES if c in rows.columns and c not in ENCODED_FEATURES])
    categorical = list(categorical if categorical is not None else [c for c in CATEGORICAL_FEATURES if c in rows.columns])
    words = Pipeline(stages=[RegexTokenizer(inputCol=text_col, outputCol="_uni", pattern="\\w\\w+", gaps=False, toLowercase=True),
                             NGram(n=2, inputCol="_uni", outputCol="_bi")])
    rows = rows.where(F.col("split").isin("train", "valid")).select(KEY, LABEL, "split", text_col, *numeric, *categorical)
    with files.kept_tables(rows.sparkSession) as keep:
        return _text_model(rows, keep, words, list(reg_params), text_col, numeric, categorical, min_df, vocab_size, min_frequency)


def _text_model(rows: DataFrame, keep: Callable[[DataFrame], DataFrame], words, reg_params: list[float], text_col: str, numeric: list[str],
                categorical: list[str], min_df: float, vocab_size: int, min_frequency: int) -> tuple[object, list[dict]]:
    """``text_model`` of the rows it needs. The text is kept and not its terms, which take many times its bytes: each of the four passes that read them splits it anew."""
    from pyspark.ml.feature import IDF, CountVectorizer
    rows = keep(in_small_methods(rows, LABEL))
    split = lambda s: rows.where(F.col("split") == s).drop("split")
    train = split("train")
    categories = written(fit_category_tables(train, categorical, min_frequency))
    split_words = words.fit(train)

    def terms(df: DataFrame) -> DataFrame:
        return split_words.transform(df).withColumn("_terms", F.concat("_uni", "_bi")).drop("_uni", "_bi")

    tr_terms = terms(keep(class_weight_column(apply_category_tables(train, categories, categorical))))
    frequent = tr_terms.select(F.explode(F.array_distinct("_terms")).alias("t")).groupBy("t").count().where(F.col("count") >= min_df).count()
    table = feature_stages(numeric, categorical)
    table[-1].setOutputCol("table_features")
    vec = Pipeline(stages=[fit_imputer(table[0], tr_terms), *table[1:], CountVectorizer(inputCol="_terms", outputCol="_tf", minDF=min_df, vocabSize=vocab_size),
                           IDF(inputCol="_tf", outputCol="text_features"),
                           VectorAssembler(inputCols=["table_features", "text_features"], outputCol="features")]).fit(tr_terms)
    tr = keep(vec.transform(tr_terms).select(LABEL, "weight", "features"))  # read by every setting
    va = keep(vec.transform(terms(apply_category_tables(split("valid"), categories, categorical))).select(KEY, LABEL, "features"))

    def fit(rp: float) -> tuple:
        m = LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol="weight", regParam=rp, maxIter=100).fit(tr)
        scored = m.transform(va).withColumn("raw_score", vector_to_array("probability").getItem(1))
        return EV.roc_auc(scored.select(KEY, LABEL, "raw_score"), LABEL, "raw_score").first()["roc_auc"], m

    results = side_by_side(fit, reg_params, tr.count(), TEXT_ROWS_AT_ONCE, rows.sparkSession)
    report = [{"regParam": rp, "valid_roc_auc": auc, "dropped_terms": max(0, frequent - vocab_size)} for rp, (auc, _) in zip(reg_params, results)]
    _, m = max(results, key=lambda r: r[0] or 0.0)  # the first of equal ones
    return (split_words, categories, vec, m), report


def select_feature_columns(df: DataFrame, deny: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical model inputs from the schema (driver-side metadata),
    minus the target, the date, the leakage columns and a caller's deny list."""
    from pyspark.sql import types as T
    from ..functions.constants import LEAKAGE_COLUMNS
    excluded = {LABEL, "arrival_date", "booking_text", *LEAKAGE_COLUMNS, *deny}
    cols = [f for f in df.schema.fields if f.name not in excluded]
    numeric = [f.name for f in cols if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    categorical = [f.name for f in cols if f.name not in numeric and isinstance(f.dataType, T.StringType)]
    return numeric, categorical


def usable_columns(df: DataFrame, numeric: list[str], categorical: list[str]) -> list[str]:
    """Columns that tell rows apart: there, with two known values at least (one pass, one row)."""
    known = lambda c: F.col(c) if c in numeric else F.when(~F.col(c).isin("Unknown"), F.col(c))
    there = [c for c in [*numeric, *categorical] if c in df.columns]
    row = df.agg(*[(F.min(known(c)) < F.max(known(c))).alias(c) for c in there]).first()
    return [c for c in there if row[c]]


def shared_columns(first: DataFrame, second: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical inputs that both sources can feed: a column that is missing, constant or
    unknown in either one leaves the set."""
    numeric = [c for c in (NUMERIC_FEATURES if numeric is None else numeric) if c not in ENCODED_FEATURES]
    categorical = list(CATEGORICAL_FEATURES if categorical is None else categorical)
    both = set(usable_columns(first, numeric, categorical)) & set(usable_columns(second, numeric, categorical))
    return [c for c in numeric if c in both], [c for c in categorical if c in both]


def cross_dataset_validation(first: DataFrame, second: DataFrame, candidates=None, seed: int = 42) -> tuple[TrainedModel, DataFrame]:
    """Train on the columns that both sources share, then evaluate on the first one's test rows and on all of the second.

    Returns the model and two rows: dataset, n, base_cancel, roc_auc, pr_auc, brier, precision20, recall20, lift20."""
    from .rank import assign_split, fill_empty_splits
    # both sources are read by the column tests, the training and the evaluation: their columns are written once
    first, _ = assign_split(first)
    inputs = list(dict.fromkeys([KEY, LABEL, "split", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, *ENC.TARGET_ENCODED_COLUMNS]))
    first, second = (df.select(*[c for c in inputs if c in df.columns]).checkpoint(eager=True) for df in (first, second))
    numeric, categorical = shared_columns(first, second)
    others = [c for c in ENC.TARGET_ENCODED_COLUMNS if c not in CATEGORICAL_FEATURES]
    both = set(usable_columns(first, [], others)) & set(usable_columns(second, [], others))
    encoded = [c for c in ENC.TARGET_ENCODED_COLUMNS if c in categorical or c in both]
    first, _ = fill_empty_splits(first, _split_sizes(first), seed)
    model = train_model(first, candidates, seed=seed, numeric=numeric, categorical=categorical, encoded=encoded)
    out = None
    for name, rows in (("main_test_common", first.where(F.col("split") == "test")), ("external_additional", second)):
        scored = apply_calibration(raw_probability(model, rows), model.calibrator).select(KEY, LABEL, "calibrated").checkpoint(eager=True)
        base = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(LABEL).cast("double")).alias("base_cancel"))
        m = EV.score_metrics(scored, LABEL, "calibrated", KEY, [0.20], "ceil", written=True)
        row = base.crossJoin(m).select(F.lit(name).alias("dataset"), "n", "base_cancel", "roc_auc", "pr_auc", "brier", F.col("precision_at_20").alias("precision20"),
                                       F.col("recall_at_20").alias("recall20"), F.col("lift_at_20").alias("lift20"))
        out = row if out is None else out.unionByName(row)
    return model, out


def score_bookings(spark, prepared: DataFrame, model_path: str | None = None, require_trained: bool = False) -> DataFrame:
    """M21 entry: trained model when present, else the deterministic rule score (M1)."""
    from .business import enrich_predictions, score_with_rules
    model = load_model(spark, model_path, require_trained) if model_path else None
    if model is None:
        if require_trained:
            raise FileNotFoundError("no model path given")
        return enrich_predictions(score_with_rules(prepared))
    return predict(model, prepared)
