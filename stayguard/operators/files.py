"""Small files on the file system of a path (any that Spark reads): existence, listing, text, atomic pointers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def _at(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf), target


def exists(spark: SparkSession, path: str) -> bool:
    """An error of the storage is an error, not a "no"."""
    fs, target = _at(spark, path)
    return bool(fs.exists(target))


def listed(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """Data files of a folder: name -> (bytes, time of change in ms). Empty where there is no folder."""
    fs, target = _at(spark, folder)
    if not fs.exists(target):
        return {}
    found = {s.getPath().getName(): (int(s.getLen()), int(s.getModificationTime())) for s in fs.listStatus(target) if s.isFile()}
    return {n: v for n, v in found.items() if not n.startswith(("_", "."))}


def data_files(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Data files at or below a path: full name -> (bytes, time of change in ms)."""
    fs, target = _at(spark, path)
    if fs.getFileStatus(target).isFile():
        found = [fs.getFileStatus(target)]
    else:
        found, walk = [], fs.listFiles(target, True)
        while walk.hasNext():
            found.append(walk.next())
    hidden = lambda p: p.getName().startswith(("_", "."))
    return {s.getPath().toUri().getPath(): (int(s.getLen()), int(s.getModificationTime())) for s in found if not hidden(s.getPath())}


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


@contextmanager
def kept_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table to the shared checkpoint folder and reads it back; its tables are removed at the end.

    They are Parquet: a tenth to a quarter of the bytes of ``checkpoint()``, which writes rows as they lie in memory. Reading many columns takes longer."""
    folder = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        remove(spark, folder)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None where there is none."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    fs, target = _at(spark, path)
    stream = fs.create(target, overwrite)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def point(spark: SparkSession, path: str, text: str) -> None:
    """Replace a pointer file in one rename: a reader sees the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new = f"{path}-{uuid.uuid4().hex}"
    _write(spark, new, text, True)
    fs, target = _at(spark, path)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(jvm.org.apache.hadoop.fs.Path(new), target, options)


#: A lock older than this (ms) was left by a process that died.
STALE_MS = 3_600_000


def lock(spark: SparkSession, path: str) -> bool:
    """Take a lock file; False where another one holds it."""
    fs, target = _at(spark, path)
    if fs.exists(target) and time.time() * 1000 - fs.getFileStatus(target).getModificationTime() > STALE_MS:
        fs.delete(target, False)
    try:
        _write(spark, path, "", False)
    except Exception:
        if exists(spark, path):
            return False
        raise
    return True
