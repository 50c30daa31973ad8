"""SparkSession settings used by the tests and the benchmark.

On a cluster the session comes from the platform; nothing here overrides a setting
that is already present, and the checkpoint folder is set only where none is named.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on: ANSI arithmetic (overflow and zero division raise),
# AQE with partition coalescing and skew-join splitting, UTC session time.  The
# DataFrame debugging context (a Python call site recorded with every Column call,
# five extra Python-to-JVM calls each) is turned off: it only enriches error messages.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "liftwise", extra: dict | None = None
) -> SparkSession:
    """A local session for tests and benchmarks (UI off, no server started)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scratch_dir(spark: SparkSession, prefix: str) -> str:
    """A new folder name under the session's checkpoint folder (shared storage on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a fresh local folder only where none is set and
    the session runs on this machine alone (tests).  On a cluster a machine's own folder
    would be lost to the other machines, so an unset one is an error there."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        try:  # a classic session may name it on the context only
            current = spark.sparkContext.getCheckpointDir()
        except Exception:  # Spark Connect has no SparkContext
            current = None
    if current:
        return current
    master = spark.conf.get("spark.master", "")
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="liftwise-ckpt-")
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:
        pass
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:
        pass
    return path
