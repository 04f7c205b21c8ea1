"""Every query that has an SQL twin gives the same rows as the other engine."""

import pytest

from foliary.plans import catalog
from tests.helpers import plain, views

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        expected = db.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert plain(got) == plain(expected)


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() == 50
