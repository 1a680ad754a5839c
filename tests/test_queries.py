"""Every registered query of the engine against its SQL, on the small tables."""

from __future__ import annotations

import pytest
from compare import duck, normal

from sluice.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, small, con, name):
    assert normal(QUERIES[name](spark, small).toPandas()) == normal(con.sql(SQL[name]).df())


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


def test_entry_without_and_with_the_optional_part(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert e.entry(spark).columns
