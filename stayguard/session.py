"""Session helpers: the engine never owns a global session; callers pass one in."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the engine's plans. AQE re-plans joins at runtime
# (broadcast only when the measured side is under the threshold), coalesces
# small shuffle partitions and splits skewed join partitions.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture for error messages walks the Python stack and makes a JVM
    # round trip on every DataFrame API call; plans here are built from hundreds
    # of expressions, so it is switched off (errors still carry the JVM context).
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Feature preparation is one wide projection; when a whole-stage method grows
    # past the JIT's 8000-byte limit it would run interpreted (4-5x slower), so
    # Spark falls back to per-expression codegen for such a stage instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "stayguard") -> SparkSession:
    """A local session for tests and the bench (the UI server stays off)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("STAYGUARD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set at most once.

    A folder that is already set is returned as it is (setting it again would nest a
    new folder in it each time), else the one that ``spark.checkpoint.dir`` names is
    set. A scratch folder is made only for a session that runs in one process
    (``local[...]``, as in tests) and is removed when that process ends; on a cluster a
    missing setting is an error, because a folder of one machine is not shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="stayguard-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()
