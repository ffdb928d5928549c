import os

import pytest
from conftest import SMALL

from chunklake.llm import queries


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, same_as_sql, name):
    sql = queries.oracle_sql().get(name)
    if sql:
        same_as_sql(spark, SMALL, queries.queries()[name], sql)
    else:
        assert queries.queries()[name](spark, SMALL).count() >= 0
