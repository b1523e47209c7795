"""Every core query against its SQL; those without SQL at least run."""

import pytest

from koengine import catalog
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, data, duck, name):
    same(spark, duck, data, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
