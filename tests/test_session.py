from types import SimpleNamespace

import pytest

from loadweave.session import scratch_path, scratch_root, stage


class Context:
    folder, master = None, "local[4]"

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def session(named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=Context())


def test_named_folder_is_used():
    assert scratch_root(session("hdfs:///shared/")) == "hdfs:///shared"


def test_private_folder_is_set_once():
    bare = session()
    assert scratch_root(bare) == scratch_root(bare) == bare.sparkContext.folder


def test_staged_tables_lie_in_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(5), "numbers")
    assert staged.count() == 5 and all(root in f for f in staged.inputFiles())
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_no_private_folder_on_a_cluster():
    bare = session()
    bare.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(bare)
