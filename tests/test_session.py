import pytest

from lexiweave.core import session


class Conf:
    def __init__(self, value=None):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class Context:
    applicationId = "app-1"

    def __init__(self, master, value=None):
        self.master, self.value = master, value

    def getConf(self):
        return Conf(self.value)


class Session:
    def __init__(self, master, value=None):
        self.conf, self.sparkContext = Conf(value), Context(master, value)


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(Session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("spark://host:7077"))
    assert session.shared_dir(Session("local[2]")).startswith("file:///")


def test_written_tables_cut_lineage(spark):
    df = session.materialise(spark.range(5).withColumnRenamed("id", "x"), "test")
    assert sorted(r.x for r in df.collect()) == list(range(5))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
