"""Every checked query against its SQL twin; queries without one must return rows."""

import compare
import pytest

from armwave.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_same_as_sql(spark, sf_dir, con, name):
    query = QUERIES[name]
    assert compare.difference(query.run(spark, sf_dir), con, query.sql) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_returns_rows(spark, sf_dir, name):
    assert QUERIES[name].run(spark, sf_dir).limit(1).count() == 1


def test_driver_contract(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
