"""Every query outside the optional subpackage against its SQL, or for rows where there is none."""

import pytest

from lexiweave.plans import catalog
from oracle import assert_same

ENTRIES = catalog.entries()
#: Too few opposites in the smallest tables.
MAY_BE_EMPTY = {"axis_assembly"}


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_same_as_sql(spark, data, name):
    assert_same(spark, data, ENTRIES[name])


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if not e.sql))
def test_has_rows(spark, data, name):
    assert ENTRIES[name].run(spark, data).count() >= (name not in MAY_BE_EMPTY)


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
