"""Every registered query of the subpackage against its SQL twin."""

import compare
import pytest

from armwave.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    assert compare.difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None
