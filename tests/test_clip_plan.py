from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from stayguard.operators import select


def test_rows_meet_their_bounds_and_cells_without_a_shuffle(spark):
    """The rows of a group stay where they are: bounds and wanted cells come to them."""
    rows = spark.range(20000).selectExpr("if(id % 5 = 0, null, concat('g', id % 3)) as g", "cast(id * 7919 % 20011 as double) as v")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cells = select.cut(rows, ["g"], "v", [0.1, 0.9], "_c")
        plan = cells._jdf.queryExecution().executedPlan().toString()
        wanted = select.same(cells, select.fixed(cells.where("_c = 1").select("g", "_c").distinct()), ["g", "_c"], "left_semi")
        semi = wanted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    for text in (plan, semi):
        assert "BroadcastHashJoin" in text and not re.search(r"SortMergeJoin|ShuffledHashJoin|Exchange hashpartitioning", text)
    got = {(r["g"], r["prob"]): r["q"] for r in select.exact_quantiles(rows, "v", [0.001, 0.5], partition_by=["g"]).collect()}
    values = {}
    for g, v in rows.collect():
        values.setdefault(g, []).append(v)
    assert len(got) == 8 and all(abs(got[g, p] - np.quantile(v, p)) < 1e-9 for g, v in values.items() for p in (0.001, 0.5))
