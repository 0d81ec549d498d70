"""Many-column lookups, ids for rows without one, stored runs, folded logs, the model store and shared columns."""
from __future__ import annotations

import datetime as dt

import pytest
from conftest import SMOKE
from pyspark.sql import functions as F

from stayguard.operators import encode as ENC
from stayguard.operators import features, files, logs
from stayguard.operators import models as M
from stayguard.operators import runs, store
from stayguard.plans import inputs


def test_lookup_of_many_columns_is_one_shuffle_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ENC, "HOT_PARTS", 3)  # keys above a third are hot, the others go through the shuffled join
    rows = [(i, "hot" if i % 2 else f"k{i % 7}", None if i % 5 == 0 else f"v{i % 3}", f"x{i}") for i in range(200)] + [(1, "hot", "v1", "x1")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string").repartition(4)
    table = [("a", "hot", 100, 0.5), ("a", "k2", 9, 0.25), ("b", "v1", 50, 0.1), ("b", "v2", 40, 0.2), ("c", "x1", 1, 0.9), ("zz", "hot", 1, 9.0)]
    stats = spark.createDataFrame(table, "column string, key string, n long, m double")
    out = ENC.lookup_columns(df, {c: F.col(c) for c in "abc"}, stats, ["n", "m"])
    want = {(c, k): (n, m) for c, k, n, m in table}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        for c in "abc":
            f = r["_found"][c] if r["_found"] is not None else None
            assert (None if f is None else tuple(f)) == want.get((c, r[c]))


def test_wide_encoding_counts_train_only(spark):
    cols = ENC.WIDE_FREQUENCIES
    make = lambda v: tuple(f"{v}{c}" for c in cols)
    schema = ", ".join(f"{c} string" for c in cols) + ", is_canceled int, split string"
    df = spark.createDataFrame([make("a") + (1, "train"), make("a") + (0, "train"), make("b") + (1, "train"), make("b") + (0, "test"), make("new") + (1, "test")], schema)
    out = ENC.wide_encoding(df, df.where("split = 'train'")).where("split = 'test'").orderBy("country").collect()
    made = [c for c in out[0].asDict() if c.endswith(("_freq_log", "_target_mean_smooth"))]
    assert len(made) == 15 and "hotel_target_mean_smooth" not in made
    prior = 2 / 3
    assert out[0]["company_target_mean_smooth"] == pytest.approx((1 + prior * 100) / 101) and out[0]["hotel_freq_log"] == pytest.approx(0.6931471805599453)
    assert out[1]["country_target_mean_smooth"] == pytest.approx(prior) and out[1]["agent_freq_log"] == 0.0


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_ids_follow_from_the_content(spark, kind, monkeypatch):
    monkeypatch.setattr(features, "COPIES", 4)
    rows = [(None, "x", 1), (None, "x", 1), (None, "y", 2), (None, None, None)] + [(None, "hot", 3)] * 11 + [(-1, "g", 1), (7, "g", 2), (-3, "g", 3)]
    df = spark.createDataFrame(rows, "booking_id long, a string, b int").withColumn("booking_id", F.col("booking_id").cast(kind))
    one = features._with_ids(df.repartition(5)).collect()
    two = features._with_ids(df.coalesce(1).orderBy(F.desc("b"))).collect()
    by = lambda rs: sorted(((r["booking_id"], r["a"], r["b"]) for r in rs), key=str)
    assert by(one) == by(two) and len({r["booking_id"] for r in one}) == len(rows)
    assert {str(r["booking_id"]) for r in one if r["a"] == "g"} == {"-1", "7", "-3"}
    if kind == "string":  # ids that an earlier run gave are kept clear of
        again = features._with_ids(spark.createDataFrame([(r["booking_id"], r["a"], r["b"]) for r in one], df.schema).unionByName(df)).collect()
        assert len({r["booking_id"] for r in again}) == 2 * len(rows) - 3
    assert features._with_ids(df.limit(0)).count() == 0


def test_run_deltas(spark, tmp_path):
    root = str(tmp_path)
    metrics = lambda a, b: spark.createDataFrame([(a, b)], "roc_auc double, brier double")
    for k, (run, model, a) in enumerate([("r1", "m", 0.5), ("x", "other", 0.9), ("r2", "m", 0.6), ("r2", "m", 0.7)]):
        runs.record_run(metrics(a, a / 2), root, run, model, dt.datetime(2024, 1, 1 + k))
    got = {r["metric"]: (r["previous_run"], r["previous"], r["current"], round(r["delta"], 9)) for r in runs.run_deltas(spark, root, "r2").collect()}
    assert got == {"roc_auc": ("r1", 0.5, 0.7, 0.2), "brier": ("r1", 0.25, 0.35, 0.1)}
    assert {r["previous"] for r in runs.run_deltas(spark, root, "r1").collect()} == {None}


def test_logs_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "TAIL", 5)
    monkeypatch.setattr(logs.append, "__defaults__", (5,))
    root = str(tmp_path)
    for i in range(14):
        store.set_status(spark, root, f"b{i % 4}", store.STATUSES[i % 3], name=f"n{i}")
    assert len(files.listed(spark, f"{root}/ledger")) <= 6
    led = logs.read(spark, root, "ledger", store.LEDGER)
    assert led.count() == 14 and {r["batch_id"] for r in store.batch_status(spark, root).collect()} == {"b0", "b1", "b2", "b3"}
    assert files.lock(spark, f"{root}/ledger_snapshots/LOCK") and not logs.fold(spark, root, "ledger", store.LEDGER)  # another one is at it


def test_a_fold_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for i in range(4):
        store.set_status(spark, root, f"b{i}", "created")
    monkeypatch.setattr(files, "point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        logs.fold(spark, root, "ledger", store.LEDGER)
    monkeypatch.undo()
    assert logs.read(spark, root, "ledger", store.LEDGER).count() == 4
    real = files.remove
    monkeypatch.setattr(files, "remove", lambda spark, path: real(spark, path) if path.endswith("LOCK") else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        logs.fold(spark, root, "ledger", store.LEDGER)  # after the pointer moved: the tail is still there and counts once
    monkeypatch.undo()
    assert logs.read(spark, root, "ledger", store.LEDGER).count() == 4 and logs.fold(spark, root, "ledger", store.LEDGER)
    assert logs.read(spark, root, "ledger", store.LEDGER).count() == 4 and not files.listed(spark, f"{root}/ledger")


def test_a_save_that_dies_leaves_the_model_before(spark, tmp_path):
    prepared = inputs.prepared(spark, SMOKE)
    path = str(tmp_path / "model")
    lr = lambda name, it: [(name, "logreg", {"regParam": 1e-2, "maxIter": it})]
    first = M.train_model(prepared, candidates=lr("first", 5))
    M.save_model(first, path)
    second = M.train_model(prepared, candidates=lr("second", 3))
    broken = M.TrainedModel(pipeline=second.pipeline, encoder=second.encoder, categories=M.CategoryTables(modes=second.categories.modes, kept=None), name="second")
    with pytest.raises(AttributeError):
        M.save_model(broken, path)  # dies between the pipeline and the meta data
    assert M.load_model(spark, path).name == "first"
    M.save_model(second, path)
    assert M.load_model(spark, path).name == "second" and len(M.load_model(spark, path).categorical) == len(second.categorical)


def test_training_on_shared_columns(spark):
    from stayguard.operators.features import prepare_features
    from stayguard.plans.dataset_queries import prepared_second
    first = inputs.prepared(spark, SMOKE)
    second = prepare_features(prepared_second(spark, SMOKE), keep=("is_canceled",))
    numeric, categorical = M.shared_columns(first, second)
    for c in numeric:
        for df in (first, second):
            lo, hi = df.agg(F.min(c), F.max(c)).first()
            assert lo < hi
    for c in categorical:
        for df in (first, second):
            assert df.where(F.col(c) != "Unknown").select(c).distinct().count() > 1
    left_out = set(M.CATEGORICAL_FEATURES) - set(categorical)
    assert left_out and all(min(df.where(F.col(c) != "Unknown").select(c).distinct().count() for df in (first, second)) < 2 for c in left_out)
    model, rows = M.cross_dataset_validation(first, second, candidates=[("lr", "logreg", {"regParam": 1e-2, "maxIter": 10})])
    got = {r["dataset"]: r for r in rows.collect()}
    assert set(got) == {"main_test_common", "external_additional"} and got["external_additional"]["n"] == second.count()
    assert model.categorical == categorical and set(model.encoder.columns) <= {*categorical, "agent", "company_raw"}
    assert all(0 <= r["roc_auc"] <= 1 for r in got.values())


def test_boosting_stops_early_and_reports_rounds(spark):
    model = M.train_model(inputs.prepared(spark, SMOKE), candidates=[
        ("a", "gbt", {"maxIter": 8, "maxDepth": 2, "validationTol": 0.5}), ("b", "gbt", {"maxIter": 3, "maxDepth": 2, "validationTol": 0.0})])
    rounds = {r["name"]: r["rounds"] for r in model.metrics["candidate_metrics"]}
    assert 1 <= rounds["a"] < 8 and 1 <= rounds["b"] <= 3


def test_fingerprint_reads_new_files_only(spark, tmp_path):
    table, root = str(tmp_path / "a b+c" / "t"), str(tmp_path / "store")
    rows = spark.range(100).selectExpr("id", "cast(id % 7 as string) as s", "if(id % 5 = 0, null, id / 3) as x")
    rows.repartition(4).write.parquet(table)
    whole = lambda: store.fingerprint(spark.read.parquet(table)).first()
    first, read = store.fingerprint_files(spark, table, root)
    assert read == 4 and tuple(first.first()) == tuple(whole())
    rows.where("id < 10").coalesce(1).write.mode("append").parquet(table)
    again, read = store.fingerprint_files(spark, table, root)
    assert read == 1 and tuple(again.first()) == tuple(whole()) and again.first()["rows"] == 110
    same, read = store.fingerprint_files(spark, f"file:{table}", root)
    assert read == 0 and same.first() == again.first()


def test_only_files_with_quoted_line_ends_are_read_whole(spark, tmp_path):
    from stayguard.sources.readers import files_with_quoted_line_ends, read_csv_files
    plain, broken = str(tmp_path / "plain 1.csv"), str(tmp_path / "broken.csv")
    with open(plain, "w") as f:
        f.write("booking_id,hotel\n" + "".join(f'{i},"The ""Grand"", {i}"\n' for i in range(4000)))
    with open(broken, "w") as f:
        f.write('booking_id,hotel\n7000,"two\nlines"\n7001,"a ""quoted\r\none"""\n7002,x\n')
    assert files_with_quoted_line_ends(spark, [plain, broken]) == {broken}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_csv_files(spark, [plain, broken])
        got = {r["booking_id"]: r["hotel"] for r in df.select("booking_id", "hotel").collect()}
        parts = read_csv_files(spark, [plain]).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts > 1 and len(got) == 4003 and got["17"] == 'The "Grand", 17' and got["7000"] == "two\nlines" and got["7002"] == "x"
