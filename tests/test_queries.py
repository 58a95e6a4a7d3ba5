"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from barspark import catalog
from helpers import same_as_sql

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same_as_sql(catalog.queries()[name], SQL[name], spark, SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    assert rows and not any(v != v for r in rows for v in r if isinstance(v, float))  # computed in full, and no NaN
