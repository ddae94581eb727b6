"""Reading the given tables and writing intermediate ones where every executor sees them."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skylag.session import materialize, shared_folder


#: Rows of whole texts that go to a Python worker at once, and their bytes; each batch is held in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = "1000", "4m"


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and hand them texts in small batches.

    Enough for a local session; to a cluster the package goes by ``--py-files`` or the image.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root, path = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, path]))


def free_name(frame: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes to be no column of the frame."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    return shared_folder(spark, purpose)


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts the lineage and survives a lost executor."""
    return materialize(frame, purpose)


def forget(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more; what was made of them must be written itself."""
    for frame in frames:
        for folder in {os.path.dirname(f) for f in frame.inputFiles()}:
            jvm = frame.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
