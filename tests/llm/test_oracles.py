"""The queries with a SQL twin, on the smallest tables."""
from __future__ import annotations

import duckdb
import pytest
from conftest import SMOKE

from stayguard.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_meets_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    want = con.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SMOKE).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(tuple, x[sorted(want.columns)].astype(object).astype(str).to_numpy().tolist())) for x in (got, want)]
    assert rows[0] == rows[1]
