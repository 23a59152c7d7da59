import os

import pytest

from kbspark.llm import queries
from tests.oracle import SMALL, rows_of, rows_of_sql


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, name):
    found = rows_of(queries.QUERIES[name](spark, SMALL))
    if name in queries.SQL:
        assert found == rows_of_sql(queries.SQL[name])
