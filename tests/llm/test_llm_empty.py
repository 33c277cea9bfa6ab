from pathlib import Path

import pytest

from lexiweave.llm.queries import registry


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for p in Path(data).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(out / p.name))
    return str(out)


@pytest.mark.parametrize("name", sorted(registry))
def test_empty_tables(spark, empty, name):
    assert registry[name].run(spark, empty).collect() == []
