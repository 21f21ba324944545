"""Session defaults and the shared staging area."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Frames are wide rows: small Arrow batches keep a Python worker's memory flat.
FRAME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def build_session(master: str = "local[8]", app: str = "framepair", **conf: str) -> SparkSession:
    """A session with the frame-friendly defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in FRAME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    If that is unset, a local session gets a temporary folder that goes with the
    process; on a cluster executors would not see each other's files, so it raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="framepair-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staging_path(spark: SparkSession, tag: str) -> str:
    return f"{staging_root(spark)}/framepair/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared staging folder and read it back.

    Cuts lineage on storage that outlives executors, and pins values that a
    re-run could change (range-partition boundaries, generated positions).
    """
    spark = df.sparkSession
    path = staging_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
