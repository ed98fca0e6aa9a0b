import pytest

import __spark_entry__ as entry
from lociweave.plans import queries

from .duck import same_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)


def test_registry(spark):
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["i", "j", "d"]
