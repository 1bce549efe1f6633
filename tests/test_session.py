"""Where intermediate tables go."""

import pytest

from docketry import session


class FakeConf:
    def __init__(self, values):
        self.values = values

    def get(self, key):
        return self.values.get(key)


class FakeContext:
    def __init__(self, master, conf, folder=None):
        self.master, self.conf, self.folder = master, conf, folder

    def getConf(self):
        return FakeConf(self.conf)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class FakeSession:
    def __init__(self, *args):
        self.sparkContext = FakeContext(*args)


def test_folder_comes_from_the_setting():
    assert session.shared_dir(FakeSession("spark://x", {"spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"
    assert session.shared_dir(FakeSession("yarn", {}, "hdfs:///d")) == "hdfs:///d"


def test_cluster_without_setting_is_refused_and_local_makes_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("spark://x", {}))
    with pytest.raises(ValueError):
        session.shared_dir(FakeSession("local-cluster[2,1,1024]", {}))
    local = FakeSession("local[2]", {})
    assert session.shared_dir(local) == local.sparkContext.folder


def test_written_tables_are_read_back(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = session.written(df, "numbers")
    assert sorted(r["k"] for r in out.collect()) == list(range(10))
    assert "FileScan" in out._jdf.queryExecution().executedPlan().toString()
