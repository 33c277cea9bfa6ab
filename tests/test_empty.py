"""Every query over empty tables: no query may fail."""

from pathlib import Path

import pytest

from lexiweave.plans import catalog


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for p in Path(data).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(out / p.name))
    return str(out)


@pytest.mark.parametrize("name", sorted(catalog.entries()))
def test_empty_tables(spark, empty, name):
    catalog.entries()[name].run(spark, empty).collect()
