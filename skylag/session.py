"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Recording the Python line of every Column costs more than planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Exact percentiles keep this many cells per task in memory before they sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def build_session(app_name: str = "skylag", master: str | None = None, **overrides) -> SparkSession:
    """Create or reuse a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, set on the context if it is not yet.

    Only where the session names none and the master is local a temporary folder takes its place, which goes when
    Python ends. On a cluster a folder of one machine would be out of the executors' sight, so that fails.
    """
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if active.isDefined():
        return root or active.get()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="skylag-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A name for a new folder that every executor can see."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and its size known to Catalyst.

    For intermediate results that several branches of one plan read.
    """
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
