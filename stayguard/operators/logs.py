"""Append-only logs as a snapshot and a tail.

A row is appended as a small file of its own in ``<root>/<name>``. When the tail has more than ``TAIL``
files they are folded: snapshot and tail are written as a new snapshot, a pointer is renamed to it, and the folded
files are removed. A snapshot lists the files that it holds, so a reader between rename and removal counts no row twice,
and one that reads the old pointer finds the old snapshot, which goes one fold later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Small files that a log may have beside its snapshot.
TAIL = 32
#: Bytes of small files that go into one file of a snapshot.
FILE_BYTES = 128 << 20


def _pointer(spark: SparkSession, root: str, name: str) -> dict:
    text = files.read_text(spark, f"{root}/{name}_snapshots/CURRENT")
    return json.loads(text) if text else {"snapshot": None, "folded": [], "previous": None, "bytes": 0}


def _read(spark: SparkSession, root: str, name: str, schema: str, pointer: dict, tail: list[str]) -> DataFrame:
    out = spark.read.schema(schema).parquet(*[f"{root}/{name}/{f}" for f in tail]) if tail else spark.createDataFrame([], schema)
    return out.unionByName(spark.read.schema(schema).parquet(pointer["snapshot"])) if pointer["snapshot"] else out


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows of a log; empty before its first one."""
    pointer = _pointer(spark, root, name)
    tail = sorted(set(files.listed(spark, f"{root}/{name}")) - set(pointer["folded"]))
    if _pointer(spark, root, name) != pointer:  # folded while the tail was listed
        return read(spark, root, name, schema)
    return _read(spark, root, name, schema, pointer, tail)


def append(rows: DataFrame, root: str, name: str, schema: str, tail: int = TAIL) -> None:
    """Append rows as one file, and fold the tail if it has grown too long."""
    rows.coalesce(1).write.mode("append").parquet(f"{root}/{name}")
    if len(files.listed(rows.sparkSession, f"{root}/{name}")) > tail:
        fold(rows.sparkSession, root, name, schema)


def fold(spark: SparkSession, root: str, name: str, schema: str) -> bool:
    """Fold the tail into the snapshot; False where another process is at it."""
    base = f"{root}/{name}_snapshots"
    if not files.lock(spark, f"{base}/LOCK"):
        return False
    try:
        pointer, there = _pointer(spark, root, name), files.listed(spark, f"{root}/{name}")
        tail = sorted(set(there) - set(pointer["folded"]))
        size = pointer["bytes"] + sum(there[f][0] for f in tail)
        new = f"{base}/{uuid.uuid4().hex}"
        _read(spark, root, name, schema, pointer, tail).coalesce(1 + size // FILE_BYTES).write.parquet(new)
        files.point(spark, f"{base}/CURRENT", json.dumps({"snapshot": new, "folded": tail, "previous": pointer["snapshot"], "bytes": size}))
        for f in there:  # all of them are in the new snapshot or were in the one before
            files.remove(spark, f"{root}/{name}/{f}")
        if pointer["previous"]:
            files.remove(spark, pointer["previous"])
    finally:
        files.remove(spark, f"{base}/LOCK")
    return True
