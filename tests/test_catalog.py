"""Every catalogue query against its SQL on DuckDB."""

import oracle
import pytest

from marginalia.plans.catalog import QUERIES
from marginalia.plans.oracle import SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    assert oracle.difference(spark, con, QUERIES[name], SQL[name], sf_dir) is None
