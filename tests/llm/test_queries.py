import pytest

from lociweave.llm import queries

from ..duck import same_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)
