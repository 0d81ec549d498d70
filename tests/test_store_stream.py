from __future__ import annotations

import csv
import json
import os
import tempfile

import pytest

from conftest import BOOKING, SECOND, frame
from stayguard.operators import store as S
from stayguard.operators.business import enrich_predictions, score_with_rules
from stayguard.operators.features import prepare_features
from stayguard.sources.readers import read_csv_files
from stayguard.operators.store import batch_status
from stayguard.streaming.files import start_file_scoring


def _write_csv(path, rows, rename=None):
    cols = list(rows[0])
    header = [rename.get(c, c) if rename else c for c in cols]
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if r[c] is None else str(r[c]) for c in cols) + "\n")


def test_persist_read_back_filter_and_audit(spark, two_bookings):
    root = tempfile.mkdtemp(prefix="stayguard-store-", dir="/tmp")
    raw, pred = _scored(two_bookings)
    bid = S.persist_predictions(spark, root, raw, pred, source="test")
    back = S.get_predictions(spark, root, bid)
    assert back.count() == 2
    assert isinstance(back.first()["top_factors"], list)
    lows = S.get_predictions(spark, root, bid, category="Low").collect()
    assert all(r["risk_category"] == "Low" for r in lows)
    assert S.list_batches(spark, root).first()["batch_id"] == bid
    events = {r["event"] for r in spark.read.parquet(f"{root}/audit").collect()}
    assert {"batch_created", "batch_scored"} <= events
    totals, latest = S.overview(spark, root)
    assert totals.first()["bookings"] == 2
    S.export_csv(spark, root, bid, f"{root}/export")
    files = [os.path.join(f"{root}/export", f) for f in os.listdir(f"{root}/export") if f.endswith(".csv")]
    rows = [r for f in files for r in csv.DictReader(open(f, newline=""))]
    assert len(rows) == 2 and all(None not in r and isinstance(json.loads(r["top_factors"]), list) for r in rows)


def _scored(raw):
    raw = S.with_row_id(raw)
    return raw, enrich_predictions(score_with_rules(prepare_features(raw, keep=(S.ROW,))))


def test_retry_after_a_crash_before_the_header(spark, two_bookings, monkeypatch):
    root = tempfile.mkdtemp(prefix="stayguard-store-")
    raw, pred = _scored(two_bookings)
    done = S._replace

    def dies(df, root, name):
        if name == "batches":
            raise RuntimeError("lost")
        done(df, root, name)

    monkeypatch.setattr(S, "_replace", dies)
    with pytest.raises(RuntimeError):
        S.persist_predictions(spark, root, raw, pred, "test", "b")
    monkeypatch.setattr(S, "_replace", done)
    assert S.get_predictions(spark, root, "b").count() == 0  # no header, so nothing is seen
    S.persist_predictions(spark, root, raw, pred, "test", "b")
    S.persist_predictions(spark, root, raw, pred, "test", "b")
    assert S.get_predictions(spark, root, "b").count() == 2
    assert S.headers(spark, root).count() == 1
    assert S.overview(spark, root)[0].first()["bookings"] == 2


def test_missing_and_repeated_ids_keep_their_rows(spark):
    root = tempfile.mkdtemp(prefix="stayguard-store-")
    for batch, rows in (("none", [{k: v for k, v in b.items() if k != "booking_id"} for b in (BOOKING, SECOND)]),
                        ("same", [dict(BOOKING, booking_id="X"), dict(SECOND, booking_id="X")]),
                        ("0007", [{("Booking_ID" if k == "booking_id" else k): v for k, v in b.items()} for b in (BOOKING, SECOND)])):
        raw, pred = _scored(frame(spark, rows))
        S.persist_predictions(spark, root, raw, pred, "test", batch)
        back = S.get_predictions(spark, root, batch).collect()
        assert len(back) == 2
        assert all(float(json.loads(r["raw_json"])["adr"]) == r["adr"] for r in back)
    with pytest.raises(ValueError):
        S.persist_predictions(spark, root, frame(spark, [BOOKING]), pred, "test")


def test_empty_batch(spark, two_bookings):
    root = tempfile.mkdtemp(prefix="stayguard-store-")
    raw, pred = _scored(two_bookings.limit(0))
    S.persist_predictions(spark, root, raw, pred, "test", "nothing")
    assert S.get_predictions(spark, root, "nothing").count() == 0
    assert S.get_batch(spark, root, "nothing").first()["row_count"] == 0
    assert S.overview(spark, root)[0].first()["batches"] == 1


def test_empty_store(spark):
    root = tempfile.mkdtemp(prefix="stayguard-store-")
    assert S.list_batches(spark, root).count() == 0 and S.get_batch(spark, root, "x").count() == 0
    assert S.overview(spark, root)[0].first().asDict() == {"batches": 0, "bookings": 0, "high_risk_bookings": 0, "total_expected_loss": 0.0}


def test_two_streams_on_one_store(spark):
    root = tempfile.mkdtemp(prefix="stayguard-root-")
    for row in (BOOKING, SECOND):
        inbox, ckpt = tempfile.mkdtemp(prefix="stayguard-inbox-"), tempfile.mkdtemp(prefix="stayguard-ckpt-")
        _write_csv(os.path.join(inbox, "m.csv"), [row])
        start_file_scoring(spark, inbox, root, ckpt).awaitTermination(120)
    got = S.committed(spark, root, "predictions")
    assert sorted(r["booking_id"] for r in got.collect()) == ["B-1", "B-2"]
    assert S.headers(spark, root).count() == 2


def test_csv_files_with_different_headers(spark):
    d = tempfile.mkdtemp(prefix="stayguard-csv-", dir="/tmp")
    _write_csv(os.path.join(d, "a.csv"), [BOOKING])
    _write_csv(os.path.join(d, "b.csv"), [SECOND], rename={"lead_time": "LeadTime", "adr": "avg_price_per_room"})
    raw = read_csv_files(spark, [os.path.join(d, "a.csv"), os.path.join(d, "b.csv")])
    prep = {r["booking_id"]: r for r in prepare_features(raw).collect()}
    assert prep["B-1"]["lead_time"] == 145 and prep["B-2"]["lead_time"] == 3
    assert prep["B-2"]["adr"] == 80.0


def test_file_stream_scores_each_file_once(spark):
    inbox = tempfile.mkdtemp(prefix="stayguard-inbox-", dir="/tmp")
    root = tempfile.mkdtemp(prefix="stayguard-root-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="stayguard-ckpt-", dir="/tmp")
    _write_csv(os.path.join(inbox, "m1.csv"), [BOOKING])
    _write_csv(os.path.join(inbox, "m2.csv"), [SECOND], rename={"adr": "price"})
    q = start_file_scoring(spark, inbox, root, ckpt, available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{root}/predictions").count() == 2
    st = batch_status(spark, root).collect()
    assert st and all(r["status"] == "completed" for r in st)
    # a second run over the same folder finds nothing new
    q2 = start_file_scoring(spark, inbox, root, ckpt, available_now=True)
    q2.awaitTermination(120)
    assert spark.read.parquet(f"{root}/predictions").count() == 2
