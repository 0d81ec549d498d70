"""Token counts: delta-maintained rollups.

A change is a signed row: +1 adds a document's count to the totals of its source, language
and tokenizer version, -1 takes it away; a revised count is the old row with -1 and the
new one with +1. A batch of changes is summed by those keys (partial sums before the
shuffle, so a source with most rows costs no more) and written under its batch id in one
step; the totals are the sum over committed batches. Committing a batch again replaces what
was there, so a retried or replayed commit changes nothing, and one that fails leaves what was committed.

Rows: a null source, language or version is a key of its own; null text counts 0; repeated
rows count as often as they stand; a key whose documents are all gone keeps no row; an
empty batch commits as empty; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files
from .bytewise import flat
from .scratch import folder
from .tokens import ChunkTokenizer, batches

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs bigint, n_tokens bigint"


def signed(docs: DataFrame, sign: int, version: str | Column, tokens: str | Column = "tokens") -> DataFrame:
    """Change rows of counted documents: ``sign`` is +1 for inserts, -1 for deletes."""
    version = F.lit(version) if isinstance(version, str) else version
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       version.cast("string").alias("version"), F.lit(sign).cast("bigint").alias("sign"),
                       F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint")).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change rows that replace ``old`` (change rows with +1) by ``new``."""
    return old.withColumn("sign", -F.col("sign")).unionByName(new)


def word_tokens(text: str | Column) -> Column:
    """Words (runs of anything but space and \\x09-\\x0D)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def piece_tokens(text: str | Column) -> Column:
    """Runs of ASCII letters, and other single characters that are not white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z]+|[^\x20\x09-\x0DA-Za-z]")), F.lit(0)).cast("bigint")


def counted(docs: DataFrame, path: str, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` without the text, with the number of ids that a public tokenizer file gives it."""
    kept = [c for c in docs.columns if c not in (text_col, out)]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ChunkTokenizer(path)
        for b in parts:
            data, offsets = flat(b.columns[-1])
            n: list[int] = []
            for first, last in batches(data, offsets):
                n += np.diff(tokenizer.encode(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])[1]).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*kept, out])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    return docs.select(*kept, text_col).mapInArrow(count, f"{fields}`{out}` bigint")


#: Committed batches beside the snapshot before the oldest are folded, and how many stay open for another commit.
FOLD_AT, KEPT_OPEN = 64, 32


class Rollup:
    """Totals in a folder that driver and executors share.

    A commit writes its sums to a folder of its own and then renames one pointer to it, so one that dies
    leaves what was committed before, and a reader sees the old sums or the new ones. Old batches are
    folded into a snapshot: they are closed, and committing one again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or folder(spark, "rollup")

    def _snapshot(self) -> dict:
        text = files.read_text(self.spark, f"{self.path}/SNAPSHOT")
        return json.loads(text) if text else {"folder": None, "closed": None, "previous": None}

    def _committed(self, snapshot: dict) -> dict[int, str]:
        """Folders of the open batches (at most about FOLD_AT)."""
        names = files.listed(self.spark, f"{self.path}/commits")
        ids = [int(n) for n in names if n.lstrip("-").isdigit()]  # a pointer that was never renamed has a longer name
        found = {i: files.read_text(self.spark, f"{self.path}/commits/{i}") for i in ids if snapshot["closed"] is None or i > snapshot["closed"]}
        return {i: at for i, at in found.items() if at}

    def _state(self) -> tuple[dict, dict[int, str]]:
        while True:
            snapshot = self._snapshot()
            committed = self._committed(snapshot)
            if self._snapshot() == snapshot:  # not folded in between
                return snapshot, committed

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Sum the batch and put it in place of whatever this batch id had committed; False for a closed one."""
        closed = self._snapshot()["closed"]
        if closed is not None and batch_id <= closed:
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
        delta.write.parquet(attempt)
        files.point(self.spark, f"{self.path}/commits/{int(batch_id)}", attempt)
        open_ids = sorted(self._committed(self._snapshot()))
        if len(open_ids) > FOLD_AT:
            self.fold(open_ids[-KEPT_OPEN - 1])
        return True

    def _sums(self, snapshot: dict, committed: dict[int, str]) -> DataFrame:
        paths = [*committed.values(), *([snapshot["folder"]] if snapshot["folder"] else [])]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and version."""
        return self._sums(*self._state())

    def fold(self, upto: int) -> bool:
        """Close the batches up to an id: their sums go into the snapshot. False where another process is at it."""
        if not files.lock(self.spark, f"{self.path}/LOCK"):
            return False
        try:
            snapshot, committed = self._state()
            old = {i: at for i, at in committed.items() if i <= upto}
            new = f"{self.path}/snapshots/{uuid.uuid4().hex}"
            self._sums(snapshot, old).write.parquet(new)
            closed = upto if snapshot["closed"] is None else max(upto, snapshot["closed"])
            files.point(self.spark, f"{self.path}/SNAPSHOT", json.dumps({"folder": new, "closed": closed, "previous": snapshot["folder"]}))
            for i, at in old.items():
                files.remove(self.spark, f"{self.path}/commits/{i}")
                files.remove(self.spark, at)
            if snapshot["previous"]:
                files.remove(self.spark, snapshot["previous"])
        finally:
            files.remove(self.spark, f"{self.path}/LOCK")
        return True


def maintained(docs: DataFrame, count_old: Callable[[str], Column] = word_tokens, count_new: Callable[[str], Column] = piece_tokens,
               versions: tuple[str, str] = ("words-1", "pieces-2")) -> DataFrame:
    """The totals after a life of ``docs``: all are inserted under the old version; the texts that
    their own hash picks (five in sixteen) are deleted; every remaining document of a language
    from "en" on is revised to the new version. The second batch is committed twice.

    The batches stand for what a feed of changes would bring; each covers whole tables.
    """
    rollup = Rollup(docs.sparkSession)
    gone = F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 1) < "5"
    moved = F.coalesce(F.col("lang"), F.lit("")) >= "en"
    rollup.commit(1, signed(docs, 1, versions[0], count_old("text")))
    for _ in range(2):
        rollup.commit(2, signed(docs.filter(gone), -1, versions[0], count_old("text")))
    left = docs.filter(~gone & moved)
    rollup.commit(3, revised(signed(left, 1, versions[0], count_old("text")), signed(left, 1, versions[1], count_new("text"))))
    return rollup.totals()
