"""Session set-up shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# In a JSON object that repeats a key, the last one counts.
REPLY_SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true"}

# Settings a job should run with. Skew handling (also where it costs one more shuffle) and
# partition coalescing are left to adaptive execution; the group-limit
# threshold is raised so that the token-budget prefix (at most one row per budget token) is cut before its shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "200000",
    **REPLY_SETTINGS,
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's `spark.checkpoint.dir`; a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    created = os.environ.get("CORPUSLOOM_SCRATCH") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def materialize(df: DataFrame, name: str, path: str | None = None, tidy: bool = False) -> DataFrame:
    """Write `df` once and read it back, so that later branches neither recompute it nor repeat model calls.

    If `tidy`, the job's shuffles are removed as it ends and not when the driver next collects garbage.
    """
    spark = df.sparkSession
    target = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if tidy:
        spark.conf.set(key, "true")
    try:
        df.write.mode("errorifexists").parquet(target)
    finally:
        if tidy:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(target)
