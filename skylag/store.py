"""Results of offline jobs, kept under a key of what they were made from.

The key is a fingerprint of the input files (path, size and time of change of each, aggregated by Spark), of
the job's parameters and of this package's code. A job whose input is unchanged is not run again, in this session or another that shares the folder; once
the input or a parameter changes, the job runs anew and the result of the old state is removed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from skylag.session import checkpoint_root

DONE = "_DONE"
#: Folder of the results below the shared one.
PLACE = "kept"


@cache
def _code() -> str:
    """A digest of the modules beside this one and in the folders that the jobs' rules are in."""
    here, digest = Path(__file__).parent, hashlib.sha256()
    for module in sorted(m for folder in (".", "functions", "operators", "plans", "sources") for m in (here / folder).glob("*.py")):
        digest.update(module.read_bytes())
    return digest.hexdigest()


def fingerprint(spark: SparkSession, sources: list[str], **parameters) -> str:
    """A digest that changes with the files below ``sources``, their sizes or times, and with the parameters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sources)
    each = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    state = files.agg(F.count(F.lit(1)), F.sum("length"), F.sum(each.cast("decimal(20,0)"))).first()
    return hashlib.sha256(json.dumps([*map(str, state), _code(), parameters], sort_keys=True).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path, by Hadoop, so that any store works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def kept(spark: SparkSession, job: str, sources: list[str], build: Callable[[str], None], root: str | None = None,
         **parameters) -> str:
    """The folder with the job's result for the present state of ``sources``; ``build`` fills it if there is none.

    A result counts once its mark is there, so that a job that broke off is run again. Results of the same job over the same
    sources in an earlier state are removed after the new one is complete; what read them must have ended.
    """
    place = hashlib.sha256(json.dumps(sorted(sources)).encode()).hexdigest()[:16]
    parent = f"{(root or checkpoint_root(spark)).rstrip('/')}/{PLACE}/{job}/{place}"
    folder = f"{parent}/{fingerprint(spark, sources, **parameters)}"
    fs, path = _files(spark, folder)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{DONE}")
    if not fs.exists(mark):
        fs.delete(path, True)
        fs.mkdirs(path)
        build(folder)
        fs.create(mark).close()
        for other in fs.listStatus(path.getParent()):
            if other.getPath().getName() != path.getName():
                fs.delete(other.getPath(), True)
    return folder
