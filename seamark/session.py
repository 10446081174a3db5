"""Session settings the engine relies on, for a cluster as well as for tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Nothing here fixes a degree of parallelism for a cluster: AQE sizes shuffle
# partitions from the bytes actually written and splits the skewed ones.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# A batch sent to Python holds so many rows and bytes at most: rows are whole texts here, and 10,000 of them,
# Spark's own bound, can be any size.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def get_session(app: str = "seamark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, as the cluster names it.

    Only a session that names none (a local test) falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.mkdtemp(prefix="seamark-"), "shared")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, where the session still has Spark's defaults."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
