"""Tables written to the folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage: what is read back no longer depends on a task that ran
before, so a lost executor costs the tasks of the running stage and nothing else. What a
result reads must outlive the call, so these tables are removed when the driver's process ends.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


_MADE: list[tuple[SparkSession, str, str | None]] = []
_OWNER = os.getpid()


def _forget() -> None:
    if os.getpid() != _OWNER:  # a forked process
        return
    for spark, path, table in _MADE:
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session has ended; its own catalog went with it
            pass
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # nothing answers any more
            return


atexit.register(_forget)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with the same schema."""
    path = folder(df.sparkSession, name)
    _MADE.append((df.sparkSession, path, None))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Write ``df`` as a table of ``n`` buckets by ``key``: later joins on ``key`` do not shuffle it again."""
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", folder(spark, name)
    _MADE.append((spark, path, table))
    (df.write.format("parquet").option("compression", "none").option("path", path)
       .bucketBy(n, key).saveAsTable(table))
    return spark.table(table)
