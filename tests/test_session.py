from types import SimpleNamespace

import pytest

from skylag.session import checkpoint_root, materialize, shared_folder


class Context:
    """Stands in for a Spark context that has no checkpoint folder yet."""

    folder = None

    def __init__(self, master):
        self.master = master
        state = SimpleNamespace(isDefined=lambda: self.folder is not None, get=lambda: self.folder)
        self._jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: state))

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(configured, master="local[8]"):
    return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: configured))


def test_the_cluster_names_the_folder():
    spark = session("hdfs:///shared/checkpoints/")
    assert shared_folder(spark, "models").startswith("hdfs:///shared/checkpoints/models-")
    assert spark.sparkContext.folder == "hdfs:///shared/checkpoints/"


def test_a_local_folder_only_where_none_is_named():
    spark = session(None)
    first = checkpoint_root(spark)
    assert spark.sparkContext.folder == first == checkpoint_root(spark)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_folder(master):
    spark = session(None, master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(spark, "models")
    assert shared_folder(session("hdfs:///shared", master), "models").startswith("hdfs:///shared/models-")


def test_materialized_frames_are_equal_and_read_from_files(spark):
    frame = spark.range(5).selectExpr("id", "cast(id AS string) AS text", "array(id) AS list")
    table = materialize(frame, "test")
    assert sorted(table.collect()) == sorted(frame.collect()) and len(table.inputFiles()) > 0
