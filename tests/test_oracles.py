"""Every registered query of the engine against its oracle, on the smallest tables."""

import compare
import pytest

from tidewell import catalog, plans

SF = "/root/testdata/sf0.001"
assert plans


@pytest.fixture(scope="module")
def connection():
    return compare.views(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_oracle(spark, connection, name):
    said = compare.difference(spark, connection, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
    assert said in (None, "no rows")


#: Model fits are run by the bench and by tests/test_learning.py.
LONG = {n for n in catalog.QUERIES if n.startswith("ml")}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - LONG))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
