"""Every query of the catalogue runs; those that SQL can express give DuckDB's rows."""

from __future__ import annotations

import pytest

from lodemill.plans import catalog

from .compare import assert_same, connect


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLES:
        assert_same(got, db.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
