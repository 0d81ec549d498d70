"""A few catalogue queries against their DuckDB oracle at sf0.001 (the driver checks all at sf0.01)."""
from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMOKE

NAMES = ["booking_view", "score_table", "insights_risk", "batch_summary", "describe", "roc_auc", "avg_precision",
         "topk_metrics", "economics", "prefix_optimum", "qcut_rank", "target_encode", "f2_threshold", "segment_quality"]


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)[:10] if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["customer", "nation", "orders", "lineitem"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data missing")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SMOKE)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    cols = sorted(dcols)
    S = sorted("|".join(norm(r[c]) for c in cols) for r in sdf.collect())
    D = sorted("|".join(norm(r[dcols.index(c)]) for c in cols) for r in cur.fetchall())
    assert S == D


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "risk_category" in df.columns
